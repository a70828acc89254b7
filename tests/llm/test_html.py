"""Elements that close themselves, or that nothing closes, lose no text."""

import pytest

from paperloom.llm import html

PAGES = {
    '<article><p>first</p><svg class="i"/><p>second</p></article>': ["first", "second"],
    '<article><p>first</p><svg class="i"/><p>second</p><svg><text>no</text></svg><p>third</p></article>': ["first", "second", "third"],
    '<article><p>one <svg><path d="x"/><g><circle r="1"/></g><title>icon</title></svg> two</p><p>three</p></article>': ["one two", "three"],
    "<article><p>first</p><button>Share<p>second</p></article><p>third</p>": ["first", "Share", "second", "third"],
    "<article><p>first <button>Share</button> more</p><p>second</p></article>": ["first more", "second"],
    "<article><p>first</p><select><option>x<p>second</p></article>": ["first", "x", "second"],
    "<article><p>a</p><object data=x>fallback</object><canvas>drawn</canvas><p>b</p></article>": ["a", "fallbackdrawn", "b"],
    "<article><p>a</p><noscript>b<p>c</p></article>": ["a", "b", "c"],
    "<article><p>a</p><iframe src=x><p>b</p></article>": ["a", "b"],
    "<article><p>a</p><script>if (1 < 2) {}</script><p>b</p><style>p {}": ["a", "b"],
    "<p>a<math><mi>x</mi><mspace/><mi>y</mi></math>b</p>": ["axyb"],
}


@pytest.mark.parametrize("source", PAGES)
def test_text_after_odd_elements_stays(source):
    assert [t for _, t, clutter, _ in html.Page(source).blocks if not clutter] == PAGES[source]


def test_many_elements_that_nothing_closes(spark):
    source = "<article>" + "<button>x" * 20_000 + "<svg/>" * 20_000 + "<p>end</p></article>"
    r = html.extract_main_text(spark.createDataFrame([(1, "http://a.org/x", source)], "page_id long, url string, html string")).first()
    assert r["text"].endswith("\nend") and r["text"].count("x") == 20_000

"""Main text of web pages by wrapper induction.

Pages of one host are filled-in copies of a few templates. Each page is parsed into a tree of its block
elements, in which repeated siblings are one node. Pages of a host with the same tree and texts are copies
and count once. The host's most frequent tree is its reference, and every page of the host is aligned with it by
simple tree matching (the largest order-preserving mapping between nodes of equal label that keeps parents). Texts
are counted at three kinds of places: at aligned nodes of the reference; at paths of labels, which other
templates of the host have too; and at the nodes of each tree. A text that most pages with a place have there
is template; what varies is content. Elements that are no article by their nature (scripts, menus, forms, hidden
ones) are left out wherever they are, and so are those whose class or id is a name of such (`sidebar`, `comment-list`),
unless they hold most of the page. Where a page marks its article, and no more than that varies outside of it, the
article is taken, whole. Pages are parsed once, without recursion, so trees may be of any depth.

All counts are grouped aggregates over all pages, so a host may be of any size; what is kept of a host is
its reference and the few texts that more than half of the pages with a place share there.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, stored, table

#: Different pages that must have a place before its constant texts count as template.
LEAST_PAGES = 4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[-_]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe".split())
#: Of these, what runs to the end of the page where nothing closes it; elements whose text is none of the page's; and those that `/>` closes.
_TO_THE_END, _UNREAD, _FOREIGN = frozenset("script style textarea title".split()), frozenset("svg select button".split()), frozenset("svg math".split())
_BLOCKS = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag of the same list closes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
_NEVER = frozenset("aside dialog footer form head menu nav search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names that mark what is no article if they are a class or an id, alone or joined by hyphens with each other and with names
#: of place; names that do so however much text they hold; and elements that names do not mark.
_CLUTTER = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
_PLACE = frozenset("area bar block body bottom box button buttons container content end entry form global group header holder inner item items left link links list main outer page panel post primary right secondary section site text thread top wrap wrapper".split())
_ALWAYS = frozenset("comment comments disqus replies reply".split())
_ARTICLE = frozenset(("article", "main"))
_NAMELESS = _ARTICLE | {"html", "body"}


def _clutter_of(value: str) -> int:
    """What a class or id says: 0 nothing, 1 clutter unless it holds most of the page, 2 clutter."""
    best = 0
    for token in value.split():
        parts = [x.rstrip("0123456789") for x in _PART.split(token)]
        if not _CLUTTER.isdisjoint(parts) and all(not x or x in _CLUTTER or x in _PLACE for x in parts):
            best = max(best, 1 if _ALWAYS.isdisjoint(parts) else 2)
    return best


class Page:
    """Blocks of text of a page in order: (node, text, clutter, in an article); and its tree of block elements."""

    __slots__ = ("blocks", "labels", "children")

    def __init__(self, source: str):
        self.labels, self.children, self.blocks = ["#"], [[]], []
        # open elements: tag, node, place among the node's children, clutter, in an article, the innermost one that only its
        # name marks; of these, by number: the next one around, and the text in it
        stack = [["#", 0, 0, False, False, 0]]
        around, held = [0], [0]
        text: list[str] = []

        def flush():
            if text:
                t = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
                text.clear()
                if t:
                    top = stack[-1]
                    self.blocks.append((top[1], t, top[3], top[4], top[5]))
                    held[top[5]] += 0 if top[3] else len(t)

        def pop_to(i):
            flush()
            del stack[i:]

        marks: dict[str, list[tuple[int, int, bool]]] = {}

        def past(tag, at):
            """The place after the end tag of an element that begins before `at`, or -1 where nothing closes it. Of these elements only drawings
            stand in their own kind: another start tag comes first where one is left open. A page's tags are looked for once."""
            if tag not in marks:
                marks[tag] = [(x.start(), x.end(), x[0][1] == "/") for x in re.finditer(rf"<{tag}(?=[\s/>])[^<>]*(?<!/)>|</{tag}\s*>", source, re.I)]
            mine, depth = marks[tag], 1
            for i in range(bisect_left(mine, (at,)), len(mine)):
                _, stop, close = mine[i]
                if not close and tag not in _FOREIGN and tag not in _RAW:
                    return -1
                depth += -1 if close else tag in _FOREIGN
                if depth == 0:
                    return stop
            return -1

        at, end = 0, len(source)
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if source.startswith("<![CDATA[", m.start()):
                    text.append(entities.escape(source[m.start() + 9 : m.end()].removesuffix("]]>")))
                continue
            tag, closing = tag.lower(), m[1] or m[4]
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag in _BLOCKS:
                            pop_to(i)
                        else:
                            del stack[i:]
                        break
                    if tag not in _BLOCKS and stack[i][0] in _BLOCKS:
                        break
                continue
            if tag in _FOREIGN and m[0].endswith("/>"):
                continue
            if tag in _RAW or tag in _UNREAD:
                text.append(" ")
                stop = past(tag, at)
                if stop >= 0:
                    at = stop
                elif tag in _TO_THE_END:
                    at = end
                continue
            if tag in ("br", "hr"):
                flush()
            if tag in _VOID:
                continue
            attributes = m[3] if m[2] else m[6]
            name, clutter, named = "", False, 0
            if attributes:
                for a in _ATTRIBUTE.finditer(attributes):
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key in ("class", "id"):
                        named = max(named, 0 if tag in _NAMELESS else _clutter_of(value))
                        name = name or value.split(" ")[0]
                    elif key == "role":
                        clutter |= value in _ROLES
                    elif key == "aria-hidden":
                        clutter |= value == "true"
                    elif key == "hidden":
                        clutter = True
                    elif key == "style":
                        clutter |= _UNSEEN.search(value) is not None
                clutter |= named == 2
            if tag not in _BLOCKS:
                top = stack[-1]
                if named == 1:
                    around.append(top[5])
                    held.append(0)
                stack.append([tag, top[1], top[2], top[3] or clutter, top[4], len(held) - 1 if named == 1 else top[5]])
                continue
            # a block element closes an open paragraph, a list item the one before
            for i in range(len(stack) - 1, 0, -1):
                open_ = stack[i][0]
                if open_ == "p" or open_ in _CLOSES.get(tag, ()):
                    pop_to(i)
                    if open_ == "p":
                        continue
                    break
                if open_ in _BLOCKS and (tag not in _WITHIN or open_ in _WITHIN[tag]):
                    break
            flush()
            top = stack[-1]
            label = f"{tag}.{name}" if name and not any(c.isdigit() for c in name) else tag
            mine = self.children[top[1]]
            for i in range(top[2], len(mine)):
                if self.labels[mine[i]] == label:
                    top[2], node = i, mine[i]
                    break
            else:
                node = len(self.labels)
                self.labels.append(label)
                self.children.append([])
                top[2] = len(mine)
                mine.append(node)
            # a header is a menu or masthead of the site unless it stands in an article
            never = tag in _NEVER or tag == "header" and not top[4]
            if named == 1:
                around.append(top[5])
                held.append(0)
            inner = len(held) - 1 if named == 1 else top[5]
            stack.append([tag, node, 0, top[3] or clutter or never, top[4] or tag in _ARTICLE and not (top[3] or clutter), inner])
        if at < end:
            text.append(source[at:])
        flush()
        # a named element is clutter unless it holds more than half of the text; whatever is in one is clutter, too
        for i in range(len(held) - 1, 0, -1):
            held[around[i]] += held[i]
        lost = [False] * len(held)
        for i in range(1, len(held)):
            lost[i] = lost[around[i]] or 2 * held[i] <= held[0]
        self.blocks = [(node, t, clutter or lost[i], article) for node, t, clutter, article, i in self.blocks]

    def shape(self) -> str:
        """Labels in depth-first order, each with the number of its parent."""
        order = _order(self)
        flat = [None] * len(order)
        flat[0] = (self.labels[0], -1)
        for node, children in enumerate(self.children):
            for x in children:
                flat[order[x]] = (self.labels[x], order[node])
        return shape_of(flat)


def shape_of(flat) -> str:
    return json.dumps([x for pair in flat for x in pair], separators=(",", ":"))


def _tree(shape: str):
    """Labels and children of a shape, numbered in depth-first order."""
    flat = json.loads(shape)
    labels, children = flat[0::2], [[] for _ in flat[0::2]]
    for node, parent in enumerate(flat[1::2]):
        if parent >= 0:
            children[parent].append(node)
    return labels, children


class Alignments(dict):
    """aligned() of pairs of shapes, found once each as long as it is remembered."""

    def __missing__(self, pair):
        if len(self) > 4096:
            self.clear()
        self[pair] = aligned(*pair)
        return self[pair]


def aligned(shape: str, reference: str) -> tuple[int, ...]:
    """Simple tree matching: for each node of shape, in depth-first order, the node of reference it is mapped to, or -1."""
    (la, ca), (lb, cb) = _tree(shape), _tree(reference)
    # of pairs of nodes of equal label: how many nodes below them, themselves included, are mapped, and which children to which
    sizes: dict[tuple[int, int], tuple[int, list]] = {}
    todo = [(0, 0, False)] if la[0] == lb[0] else []
    while todo:
        a, b, ready = todo.pop()
        if (a, b) in sizes:
            continue
        if not ready:
            todo.append((a, b, True))
            todo += [(x, y, False) for x in ca[a] for y in cb[b] if la[x] == lb[y]]
            continue
        x, y = ca[a], cb[b]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        took = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                w = sizes[p, q][0] if la[p] == lb[q] else 0
                best[i][j], took[i][j] = max((best[i - 1][j - 1] + w, 2 if w else -1), (best[i - 1][j], 1), (best[i][j - 1], 0))
        pairs, i, j = [], len(x), len(y)
        while i and j:
            step = took[i][j]
            if step == 2:
                pairs.append((x[i - 1], y[j - 1]))
            i, j = i - (step != 0), j - (step in (2, -1, 0))
        sizes[a, b] = (1 + best[-1][-1], pairs)
    out = [-1] * len(la)
    found = [(0, 0)] if (0, 0) in sizes else []
    while found:
        a, b = found.pop()
        out[a] = b
        found += sizes[a, b][1]
    return tuple(out)


def _order(page: Page) -> list[int]:
    """For each node of a page its number in depth-first order."""
    out, k, todo = [0] * len(page.labels), 0, [0]
    while todo:
        node = todo.pop()
        out[node] = k
        k += 1
        todo += reversed(page.children[node])
    return out


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _paths(page: Page) -> list[int]:
    """For each node of a page a hash of the labels from the root to it."""
    out, todo = [0] * len(page.labels), [0]
    while todo:
        node = todo.pop()
        for x in page.children[node]:
            out[x] = text_key(f"{out[node]}/{page.labels[x]}")
        todo += page.children[node]
    return out


def _places(page: Page):
    """Blocks that are no clutter: numbers of their nodes in depth-first order, paths, and texts."""
    order, paths = _order(page), _paths(page)
    blocks = [b for b in page.blocks if not b[2]]
    return [order[b[0]] for b in blocks], [paths[b[0]] for b in blocks], [b[1] for b in blocks]


def _texts(batches):
    """How many contents have a text at a place, and, as the text null, how many have the place.

    A place is a node of the host's reference or a path (scope 0), or a node of one tree (scope: the tree's key)."""
    known = Alignments()
    for b in batches:
        counts: dict[tuple, int] = {}
        for host, shape, nodes, paths, texts, reference in zip(*(b.column(i).to_pylist() for i in range(6))):
            to, scope, seen = known[shape, reference], text_key(shape), set()
            for node, path, text in zip(nodes, paths, texts):
                for place in ((0, to[node]), (0, path), (scope, node)):
                    if place != (0, -1):
                        seen |= {(host, *place, text), (host, *place, None)}
            for key in seen:
                counts[key] = counts.get(key, 0) + 1
        x = [list(c) for c in zip(*counts)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.string()), *(pa.array(c, pa.int64()) for c in x[1:]), pa.array(list(counts.values()), pa.int64())], names=["host", "scope", "place", "text", "n"])


PARSED = "page_id long, url string, host string, shape string, scope long, content long, article array<boolean>, nodes array<int>, paths array<long>, texts array<string>, keys array<long>"


def _parsed(batches):
    """Blocks of each page that are no clutter. content: a key of their texts; article: which are in an article or main element."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()))
    for b in batches:
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        rows = []
        for source in c["html"].to_pylist():
            page = Page(source or "")
            nodes, paths, texts = _places(page)
            article = [x[3] for x in page.blocks if not x[2]]
            shape = page.shape()
            rows.append((shape, text_key(shape), text_key(json.dumps(texts)), article, nodes, paths, texts, [text_key(x) for x in texts]))
        found = zip(*rows) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([c["page_id"], c["url"], c["host"], *(pa.array(list(x), k) for x, k in zip(found, kinds))], names=[x.split()[0] for x in PARSED.split(", ")])


def main_text(article, nodes, paths, texts, keys, to, template: set, own: set) -> str:
    """The marked article, whole, if what is no template outside of it is no longer than it; else all blocks that are no
    template. to: for each node that of the reference, or -1. template: pairs of a reference's node or a path, and text key;
    own: pairs of a node of the page's own tree, and text key."""
    varies = [(to[node], k) not in template and (path, k) not in template and (node, k) not in own for node, path, k in zip(nodes, paths, keys)]
    inside = sum(len(x) for x, a in zip(texts, article) if a)
    outside = sum(len(x) for x, a, v in zip(texts, article, varies) if v and not a)
    return "\n".join(x for x, keep in zip(texts, article if inside and inside >= outside else varies) if keep)


def _extract(batches):
    known = Alignments()
    for b in batches:
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        out = []
        for shape, reference, template, own, *page in zip(*(c[n].to_pylist() for n in ("shape", "reference", "template", "own", "article", "nodes", "paths", "texts", "keys"))):
            pairs = ({(t["place"], t["text"]) for t in x or ()} for x in (template, own))
            out.append(main_text(*page, known[shape, reference], *pairs))
        yield pa.RecordBatch.from_arrays([c["page_id"], c["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html).

    A null or empty page has an empty text. Pages with a null url or one without a host are of one host without a
    name. Repeated rows count once when templates are found, and each gets its text; other columns are ignored;
    an empty table gives no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    parsed = stored(rows.mapInArrow(releasing(_parsed), PARSED), "parsed")
    # each content once: a host's pages with one tree and the same texts outside clutter are copies
    each = parsed.groupBy("host", "shape", "content").agg(F.first(F.struct("nodes", "paths", F.col("keys").alias("texts"))).alias("x"))
    contents = stored(each.select("host", "shape", "x.*"), "contents")
    hosts = contents.groupBy("host", "shape").count().groupBy("host").agg(F.max_by("shape", F.struct("count", "shape")).alias("reference"))
    hosts = stored(hosts, "hosts")
    place = ["host", "scope", "place"]
    texts = contents.join(hosts, "host").select("host", "shape", "nodes", "paths", "texts", "reference").mapInArrow(releasing(_texts), "host string, scope long, place long, text long, n long")
    counts = texts.groupBy(*place, "text").agg(F.sum("n").alias("n")).where(2 * F.col("n") > LEAST_PAGES)
    counts = stored(counts, "counts")
    have = counts.where(F.col("text").isNull() & (F.col("n") >= LEAST_PAGES)).select(*place, F.col("n").alias("pages"))
    common = counts.where("text is not null").join(have, place).where(2 * F.col("n") > F.col("pages"))
    pairs = F.collect_list(F.struct("place", "text"))
    template, own = common.where("scope = 0").groupBy("host").agg(pairs.alias("template")), common.where("scope != 0").groupBy("host", "scope").agg(pairs.alias("own"))
    wrappers = stored(hosts.join(template, "host", "left").select("host", "reference", "template"), "wrappers")
    pages = parsed.join(wrappers, "host").join(stored(own, "own"), ["host", "scope"], "left")
    return pages.select("page_id", "url", "shape", "article", "nodes", "paths", "texts", "keys", "reference", "template", "own").mapInArrow(releasing(_extract), "page_id long, url string, text string, n_chars long")


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_wrapper": op2_html_wrapper}

"""Local parts of any letters: none stays, all stay addresses of their domain, equal ones stay equal, and none meet."""

import random

from paperloom.llm import pii

LETTERS = "abcxyzABCXYZ0189" + "абвгдежзяАБЯ" + "αβγδωΑΩ" + "àéîõüß" + "日本語漢字" + "אבג" + "٣٤" + "𝒳"


def test_no_address_stays_in_clear(spark):
    rng = random.Random(8)
    local = {"".join(rng.choices(LETTERS, k=rng.randint(3, 14))) + rng.choice(["", ".x", "_" + rng.choice(LETTERS) * 2]) for _ in range(300)} | {"иван", "андрей.петров", "日本語"}
    rows = [(i, f"mail {x}@mail.ru, and {x}@mail.ru again") for i, x in enumerate(sorted(local))]
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    new = {}
    for r, (i, old) in zip(sorted(found, key=lambda r: r["doc_id"]), rows):
        was = old.split("@")[0][5:]
        a, b = r["text"].removeprefix("mail ").removesuffix("@mail.ru again").split("@mail.ru, and ")
        assert r["n_values"] == 2 and a == b != was and len(a) == len(was)
        assert all((x.isascii() and x.isdigit()) == (y.isascii() and y.isdigit()) and ord(x) // 128 == ord(y) // 128 for x, y in zip(was, a))
        assert [c for c in a if c in "._"] == [c for c in was if c in "._"]
        new[was] = a
    assert len(set(new.values())) == len(new)


def test_letters_beyond_ascii_are_permuted(spark):
    """All strings of two neighbours: a permutation of them."""
    some = [chr(a) + chr(b) for a in range(0x430, 0x440) for b in range(0x430, 0x440)]
    df = spark.createDataFrame([(x,) for x in some], "x string")
    out = [r[0] for r in df.select(pii.feistel_text(df["x"], "k", "email")).collect()]
    assert sorted(out) == sorted(some) and sum(a == b for a, b in zip(some, out)) < 10

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking as C
from paperloom.operators import pages as P
from paperloom.plans import catalog


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


GOLD = [
    ("First sentence here.  Second one follows! Is this third? Yes.", 4),
    ("See Fig. 3 for details, e.g. the curve. J. Smith et al. agree. Next sentence.", 3),
    ("The value is 3.14 today. Done.", 2),
    ("A heading\n\nThe body text.", 2),
    ("  \n ", 0),
    ("", 0),
]


def test_sentences_have_exact_offsets(spark):
    texts = [t for t, _ in GOLD]
    rows = C.sentences(docs(spark, *texts)).collect()
    for i, (t, n) in enumerate(GOLD):
        mine = [r for r in rows if r["doc_id"] == i]
        assert len(mine) == n
        assert all(t[r["start"] : r["end"]] == r["sentence"] == r["sentence"].strip() and r["tokens"] == len(r["sentence"].split()) for r in mine)


def test_null_text_has_no_sentences(spark):
    assert C.sentences(docs(spark, None)).count() == 0


def test_hard_split(spark):
    text = "x. " + " ".join(f"w{i}" for i in range(500)) + "."
    rows = C.hard_split(C.sentences(docs(spark, text)), 80).orderBy("sent_no").collect()
    assert [r["tokens"] for r in rows] == [80] * 6 + [21] and all(text[r["start"] : r["end"]] == r["sentence"] for r in rows)


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_packing_equals_the_sql(spark, overlap):
    """Random lists of sentence lengths against the recursive SQL, which knows prefix sums and jumps from chunk to chunk."""
    rng, s = random.Random(overlap), C.ChunkSizes(target=30, most=50, least=10, overlap=overlap)
    rows = [(d, i, rng.randint(1, 50 if d % 2 else 12), rng.random() < 0.2) for d in range(12) for i in range((1, 2, 3, 40, 200, 57)[d % 6])]
    df = spark.createDataFrame(rows, "doc_id long, sent_no int, tokens int, is_break boolean").selectExpr("*", "sent_no as start", "sent_no + 1 as end")
    got = {(r["doc_id"], r["chunk_no"], r["first"], r["last"]) for r in C.pack_groups(df.drop("is_break"), df, s).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE marked (doc_id BIGINT, i INTEGER, tok INTEGER, brk BOOLEAN)")
    duck.executemany("INSERT INTO marked VALUES (?, ?, ?, ?)", rows)
    assert got == set(duck.execute(f"WITH RECURSIVE {catalog.packed_sql(s)} SELECT doc_id, chunk_no, first, last FROM packed").fetchall())


def test_packing_by_hand(spark):
    """Target 6, most 10, least 2, one sentence of overlap: closed at the target, at a break, and before a sentence too long."""
    tokens, breaks = [3, 3, 2, 9, 1, 2, 4, 4], [False, False, False, False, False, True, False, False]
    rows = [(1, i, t, b, i, i + 1) for i, (t, b) in enumerate(zip(tokens, breaks))]
    df = spark.createDataFrame(rows, "doc_id long, sent_no int, tokens int, is_break boolean, start int, end int")
    got = C.pack_groups(df.drop("is_break"), df, C.ChunkSizes(6, 10, 2, 1)).orderBy("chunk_no").collect()
    # 0-1 reach the target; 1 is kept, 2 fits, 3 does not: 1-2; 2 is kept but leaves no room for 3; 3 alone reaches the target
    # and, being all there is, is not kept; 4-5 end at the break; 6-7 are the rest
    assert [(r["first"], r["last"]) for r in got] == [(0, 1), (1, 2), (3, 3), (4, 5), (6, 7)]


def test_chunk_sizes_are_checked():
    with pytest.raises(ValueError):
        C.ChunkSizes(target=10, least=20)


def test_chunks_cover_and_cite(spark):
    pages = spark.createDataFrame([(1, 1, "This sentence starts on page one and"), (1, 2, "ends on page two. The end comes here.")], "doc_id long, page_no int, text string")
    c = C.chunks(pages, C.ChunkSizes(100, 200, 5))
    row = C.with_spans(c, C.chunk_spans(c, pages)).collect()
    assert len(row) == 1 and [s["page"] for s in row[0]["spans"]] == [1, 2] and row[0]["chunk_id"] == "1:0000"
    spans = C.chunk_spans(spark.createDataFrame([("x", 1, 5, 14)], "chunk_id string, doc_id long, char_start int, char_end int"), spark.createDataFrame([(1, 1, "aaaa bbbb"), (1, 2, "cccc dddd")], "doc_id long, page_no int, text string"))
    assert sorted((r["page_no"], r["span_start"], r["span_end"]) for r in spans.collect()) == [(1, 5, 9), (2, 0, 4)]


def test_chunks_of_random_text_cover_every_sentence(spark):
    rng = random.Random(3)
    text = " ".join(" ".join(rng.choice(["pump", "valve", "heat", "flow"]) for _ in range(rng.randint(2, 30))).capitalize() + "." for _ in range(120))
    pages = P.pages_of_lines(docs(spark, text.replace(". ", ".\n")), 7)
    s = C.ChunkSizes(40, 60, 10)
    c = C.chunks(pages, s).cache()
    sents = C.hard_split(C.sentences(P.joined(pages)), s.most)
    assert C.uncovered(sents, c).count() == 0
    whole = P.joined(pages).first()["text"]
    for r in c.collect():
        assert r["text"] == " ".join(whole[r["char_start"] : r["char_end"]].split()) and len(r["text"].split()) <= 60


def test_semantic_breaks_need_four_sentences(spark):
    short = C.semantic_breaks(C.sentences(docs(spark, "One here. Two here. Three here.")))
    assert short.count() == 0
    text = "Pumps move water. Pumps need water. Water pumps hum. Cats eat fish. Cats like fish. Fish fear cats. Cats sleep."
    rows = C.semantic_breaks(C.sentences(docs(spark, text))).orderBy("sent_no").collect()
    assert len(rows) == 6 and any(r["is_break"] for r in rows)
    import numpy as np

    limit = np.percentile([r["similarity"] for r in rows], 20)
    assert [r["is_break"] for r in rows] == [r["similarity"] < limit for r in rows]


def test_pages(spark):
    d = docs(spark, "\n".join(f"l{i}" for i in range(45)), "", None)
    p = P.pages_of_lines(d)
    assert {r["doc_id"]: r["n"] for r in p.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 1, 2: 1}
    assert {r["doc_id"]: r["text"] for r in P.joined(p).collect()}[0] == d.first()["text"]
    picked = P.select_pages(p, "2-9, 1").where("doc_id = 0").orderBy("page_no").collect()
    assert [(r["source_page"], r["page_no"]) for r in picked] == [(1, 1), (2, 2), (3, 3)]
    assert P.empty_pages(p).count() == 2 and P.scanned_documents(p).count() == 2
    for bad in ("", "x", "1-2-3", "-"):
        with pytest.raises(ValueError):
            P.parse_page_range(bad)
    merged = P.merge_documents(p, spark.createDataFrame([("m", 1, 1), ("m", 2, 0), ("n", 1, 0)], "merged_id string, position int, doc_id long"))
    assert [(r["page_no"], r["doc_id"]) for r in merged.orderBy("page_no").collect()] == [(1, 1), (2, 0), (3, 0), (4, 0)]


def test_recognised_text_fills_in(spark):
    p = spark.createDataFrame([(1, 1, "x" * 90), (1, 2, " ")], "doc_id long, page_no int, text string")
    r = spark.createDataFrame([(1, 1, "no"), (1, 2, "seen ")], "doc_id long, page_no int, text string")
    assert P.with_recognised(p, r).first()["text"] == f"--- Page 1 ---\n{'x' * 90}\n\n--- Page 2 ---\nseen"


def test_fixed_windows(spark):
    rows = C.fixed_windows(docs(spark, " ".join(map(str, range(300))), "a b", ""), 160, 20).orderBy("doc_id", "window_no").collect()
    assert [(r["doc_id"], r["word_start"], r["word_end"]) for r in rows] == [(0, 0, 160), (0, 140, 300), (1, 0, 2)]


def test_hard_split_carries_each_word_once(spark):
    """Rows are windows, not words with their whole sentence, and sentences are made once for short and long ones."""
    text = "  ".join(f"w{i}" for i in range(1000)) + ".\n\nShort one."
    cut = C.hard_split(C.sentences(docs(spark, text)), 20)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    rows = cut.orderBy("sent_no").collect()
    assert len(rows) == 51 and all(text[r["start"] : r["end"]] == r["sentence"] for r in rows) and [r["tokens"] for r in rows] == [20] * 50 + [2]


def test_sentences_of_chunks_are_cut_once(spark):
    text = "  ".join(f"Part {i} has {'a valve' if i % 3 else 'one  pump'} and  more." for i in range(60))
    pages = docs(spark, text, "", "Short.\n\nTwo.").withColumn("page_no", F.lit(1))
    made = C.chunks(pages)
    # neither breaks nor texts are joined back
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    whole = {r["doc_id"]: r["text"] for r in pages.collect()}
    rows = made.collect()
    assert len(rows) > 2 and all(r["text"] == " ".join(whole[r["doc_id"]][r["char_start"] : r["char_end"]].split()) for r in rows)

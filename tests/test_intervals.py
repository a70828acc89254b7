import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking, intervals
from paperloom.plans import evaluate


def test_as_of(spark):
    points = spark.createDataFrame([("a", 5, "p"), ("a", 0, "q"), ("b", 9, "r"), (None, 1, "s"), ("a", 5, "p")], "k string, at int, x string")
    marks = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("a", 6, 12), (None, 1, 13)], "k string, at int, m int")
    got = sorted(((r["x"], r["m"]) for r in intervals.as_of(points, marks, "k", "at", "m").collect()), key=str)
    assert got == [("p", 11), ("p", 11), ("q", None), ("r", None), ("s", 13)]


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    pages = [(d, p, "x" * rng.choice([0, 0, 1, 7, 30])) for d in range(4) for p in range(1, 9)]
    total = {d: sum(len(t) + 1 for e, _, t in pages if e == d) for d in range(4)}
    chunks = [(f"{d}:{i}", d, a, a + rng.randint(1, 40)) for d in range(4) for i in range(25) for a in [rng.randint(0, total[d])]]
    want, starts = [], {}
    for d, p, t in pages:
        starts[d, p] = sum(len(x) + 1 for e, q, x in pages if e == d and q < p)
    for c, d, a, b in chunks:
        for e, p, t in pages:
            lo, hi = max(a, starts[e, p]) - starts[e, p], min(b, starts[e, p] + len(t)) - starts[e, p]
            if d == e and lo < hi:
                want.append((c, d, p, lo, hi))
    got = chunking.chunk_spans(spark.createDataFrame(chunks, "chunk_id string, doc_id long, char_start int, char_end int"), spark.createDataFrame(pages, "doc_id long, page_no int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_very_long_document_is_linear(spark):
    """10,000 pages and 100,000 chunks of one document: no join makes more rows than spans, where pairs would be a thousand million."""
    pages = spark.range(10_000).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.lit("x" * 99).alias("text"))
    chunks = spark.range(100_000).select(F.concat(F.lit("1:"), "id").alias("chunk_id"), F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("char_start"), (F.col("id") * 10 + 25).cast("int").alias("char_end"))
    spans = chunking.chunk_spans(chunks, pages)
    assert spans.count() == sum(1 for i in range(100_000) for p in range(i * 10 // 100, min(9_999, (i * 10 + 24) // 100) + 1) if max(i * 10, p * 100) < min(i * 10 + 25, p * 100 + 99))
    assert chunking.uncovered(spark.createDataFrame([(1, 0, 5), (1, 1, 1_000_020), (2, 0, 0)], "doc_id int, sent_no int, start int"), chunks).count() == 2


@pytest.mark.parametrize("most", [3, 100_000])
def test_selection_equals_sorting(spark, monkeypatch, most):
    monkeypatch.setattr(evaluate, "MOST", most)
    monkeypatch.setattr(evaluate, "CELLS", 20)
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([round(rng.expovariate(1), 3), 0.5, -1.0])) for _ in range(3000)] + [("one", 7.0), ("none", None), ("same", 2.0)] + [("same", 2.0)] * 400
    want = {}
    for g in {g for g, v in rows if v is not None}:
        t = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = (len(t), t[len(t) // 2], t[max(len(t) * 95 // 100 - 1, 0)])
    got = {r[0]: tuple(r[1:]) for r in evaluate.latencies(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == want

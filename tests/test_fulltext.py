import random

import pytest

from paperloom.operators import fulltext

WORDS = ["pump", "valve", "wind", "steel", "noise", "the"]


def index_of(spark, texts):
    return fulltext.positions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_positions_count_stop_words(spark):
    got = {r["term"]: r["positions"] for r in index_of(spark, ["The pumps and the valve; pump!", None, ""]).collect()}
    assert got == {"pump": [2, 6], "valve": [5]}


def plain_covers(words, terms):
    """All stretches that hold every term and no shorter one that does, by trying each."""
    held = set(terms) & set(words)
    has = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if held <= set(words[i : j + 1])] if held else []
    least = [(i, j) for i, j in has if not any((a, b) != (i, j) and a >= i and b <= j for a, b in has)]
    return sorted((i + 1, j + 1, sum(w in held for w in words[i : j + 1])) for i, j in least)


@pytest.mark.parametrize("seed", range(3))
def test_covers_by_trying_all_stretches(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 24))) for _ in range(40)]
    queries = ["pump", "pump valve", "wind steel pump", "absent", "pump absent", "valve wind steel pump"]
    found = fulltext.covers(fulltext.matches(index_of(spark, texts), asked(spark, *queries), "doc_id"), "doc_id").collect()
    got = {}
    for r in found:
        got.setdefault((r["query_id"], r["doc_id"]), []).append((r["start"], r["stop"], r["n"]))
    want = {(q, d): c for q, query in enumerate(queries) for d, t in enumerate(texts) if (c := plain_covers(t.split(), query.split()))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_closer_terms_rank_higher(spark):
    index = index_of(spark, ["pump x x x valve", "pump x valve", "pump valve", "pump pump pump", "nothing", "valve pump x x x x x x pump valve"])
    best = fulltext.cover_density(index, asked(spark, "valve pump"), "doc_id", match="most").orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == [5, 2, 1, 0, 3]
    all_ = fulltext.cover_density(index, asked(spark, "valve pump", "pump missing"), "doc_id", match="all").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in all_] == [(5, 0.2), (2, 0.1), (1, 0.05), (0, 0.025)]
    any_ = {r["doc_id"]: r["score"] for r in fulltext.cover_density(index, asked(spark, "valve valve pump"), "doc_id", match="any").collect()}
    assert any_ == {0: 0.2, 1: 0.2, 2: 0.2, 3: 0.3, 5: 0.4}
    with pytest.raises(ValueError):
        fulltext.cover_density(index, asked(spark, "x"), "doc_id", match="none")


@pytest.mark.parametrize("match", fulltext.MATCHES)
def test_matches_are_not_shuffled_by_query(spark, match):
    """Matches are counted where a text's postings lie, and covers are made of texts that can be among the best only."""
    index = fulltext.positions(spark.createDataFrame([(i, "valve pump" if i < 3 else "valve") for i in range(20)], "doc_id long, text string"), "doc_id")
    found = fulltext.cover_density(index, asked(spark, "valve pump"), "doc_id", 2, match)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1]


def test_leading_texts(spark):
    held = spark.createDataFrame([(1, i, h) for i, h in enumerate([5, 4, 4, 3, 3, 1])] + [(2, 1, 7)], "query_id long, doc_id long, held long")
    assert {r["query_id"]: r["least"] for r in fulltext._leading(held, 2).collect()} == {1: 4, 2: 0}

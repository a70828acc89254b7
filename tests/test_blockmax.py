import random

import pytest

from paperloom.operators import blockmax, index, search


@pytest.fixture(scope="module")
def corpus(spark):
    """900 texts of frequent and rare words, with ties, nulls and repeated texts."""
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(890)] + ["w1 w2 w3"] * 8 + ["", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "w1 w2 w3"), (1, "w1"), (2, "w17 w1 w2"), (3, "absent"), (4, ""), (5, "w40 w41 w42 w1"), (6, None)], "query_id int, query string")


@pytest.mark.parametrize("kind", ["live", "stemmed", "space"])
@pytest.mark.parametrize("region", [16, 4096])
def test_equals_the_plain_ranking(spark, corpus, asked, monkeypatch, kind, region):
    monkeypatch.setattr(blockmax, "REGION", region)
    made = index.build(corpus, "doc_id", kind)
    order = ["query_id", "rank"]
    for top in (1, 7, 2000):
        assert blockmax.bm25(blockmax.build(made), asked, top).orderBy(*order).collect() == search.bm25(made, asked, top).orderBy(*order).collect()


def test_few_postings_are_scored(spark, corpus, asked, monkeypatch):
    monkeypatch.setattr(blockmax, "REGION", 8)
    r = blockmax.work(blockmax.build(index.build(corpus, "doc_id", "live")), asked.where("query_id in (2, 5)"), 3).first()
    assert 0 < r["scored"] < 0.6 * r["asked"]


def test_stored_blocks_are_read_by_bucket(spark, corpus, asked, tmp_path):
    made = index.build(corpus, "doc_id", "live")
    blockmax.build(made).save(str(tmp_path / "b"))
    again = blockmax.Blocks.load(spark, str(tmp_path / "b"))
    one = asked.where("query_id = 5")
    got = blockmax.bm25(again, one, 5)
    assert got.orderBy("rank").collect() == search.bm25(made, one, 5).orderBy("rank").collect()
    plan = blockmax._read(again, search.query_terms(one, "live"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    # the scan of heads reads no lists
    heads = blockmax._read(again, search.query_terms(one, "live")).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "keys" not in heads.split("ReadSchema")[-1]

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import blocks, ivf, search

TYPES = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 unit vectors around 40 centres, one of which has a third of them."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16))
    of = np.where(rng.random(2000) < 0.33, 0, rng.integers(0, 40, 2000))
    x = centre[of] + 0.35 * rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], TYPES).cache()


def test_every_row_is_in_one_list_and_recall_is_reached(spark, clustered, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 100)
    index = ivf.build(clustered, "vec_id", ivf.Fit(lists=32))
    lists = ivf.Ivf("vec_id", index.centroids, index.lists.cache())
    keys = [k for r in lists.lists.collect() for k in r["keys"]]
    assert sorted(keys) == list(range(2000)) and max(len(r["keys"]) for r in lists.lists.collect()) <= 100
    probes = ivf.probes_for(lists, clustered, 0.9)
    q = clustered.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = ivf.search(lists, q, 10, probes)
    exact = search.dense(clustered, q, top=10)
    assert ivf.recall(got, exact, "vec_id").first()["recall"] >= 0.9
    assert probes < 32 and ivf.probed_share(lists, q, probes).first()["share"] < 0.7
    # what is found has exact scores
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in search.dense(clustered, q, top=2000).collect()}
    assert all(scores[r["query_id"], r["vec_id"]] == r["score"] for r in got.collect())


def test_all_lists_are_exact_search(spark, clustered):
    index = ivf.build(clustered, "vec_id", ivf.Fit(lists=8))
    q = clustered.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    order = ["query_id", "rank"]
    assert ivf.search(index, q, 12, 8).orderBy(*order).collect() == search.dense(clustered, q, top=12).orderBy(*order).collect()


def test_stored_index_answers_alike(spark, clustered, tmp_path):
    index = ivf.build(clustered, "vec_id", ivf.Fit(lists=8))
    index.save(str(tmp_path / "i"))
    again = ivf.Ivf.load(spark, str(tmp_path / "i"))
    q = clustered.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    assert sorted(ivf.search(again, q, 5, 2).collect()) == sorted(ivf.search(index, q, 5, 2).collect())


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, []), (5, [0.0, 1.0])]
    index = ivf.build(spark.createDataFrame(rows, TYPES), "vec_id")
    q = spark.createDataFrame([(9, [1.0, 0.5]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in ivf.search(index, q, 5, 5).orderBy("rank").collect()] == [(9, 0, 1.0), (9, 5, 0.5)]
    assert ivf.build(spark.createDataFrame([], TYPES), "vec_id").lists.count() == 0
    with pytest.raises(Exception, match="length"):
        ivf.search(index, q.withColumn("embedding", F.array(F.lit(1.0))), 5).collect()


def test_memory_does_not_grow_with_rows_times_lists(monkeypatch):
    rng = np.random.default_rng(1)
    x, c = rng.standard_normal((16384, 8)), rng.standard_normal((1024, 8))
    tracemalloc.start()
    try:
        ivf.kmeans(x, 1024, 1, 5)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20  # 128 MB would be one array of rows by centroids
    finally:
        tracemalloc.stop()
    near = x @ c.T - (c**2).sum(1) / 2
    monkeypatch.setattr(ivf, "CELLS", 5000)
    assert (ivf._nearest(x, c, 3)[0] == np.argsort(-near, axis=1, kind="stable")[:, :3]).all()
    assert (ivf._nearest(x, c)[0][:, 0] == near.argmax(axis=1)).all()

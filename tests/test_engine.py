import pytest

from paperloom.plans.engine import Engine, Settings


def answers(found):
    return [(r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in found.orderBy("query_id", "rank").collect()]


def test_indexes_answer_as_tables_do_until_documents_change(spark, tmp_path):
    e = Engine(spark, Settings(str(tmp_path / "e"), 4, semantic=False, reranker="none"))
    names = ["alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine"]
    e.ingest(spark.createDataFrame([(i, 1, f"The {n} boiler holds {30 + i} litres. It was built of {names[i - 1]} steel.") for i, n in enumerate(names)], "doc_id long, page_no int, text string"))
    q = spark.createDataFrame([(0, "How many litres does the birch boiler hold?"), (1, "pine steel"), (2, "absent")], "query_id int, query string")
    before = {m: answers(e.search(q, m)) for m in ("sparse", "hybrid")}
    with pytest.raises(KeyError):
        e.search(q, approximate=True)
    assert e.build_indexes(1.0)["probes"] >= 1
    assert {m: answers(e.search(q, m)) for m in ("sparse", "hybrid")} == before
    assert answers(e.search(q, "hybrid", approximate=True))[0][1] == before["hybrid"][0][1]
    assert {r["doc_id"] for r in e.search(q, "sparse", doc_ids=[1, 9]).collect()} <= {1, 9}
    e.ingest(spark.createDataFrame([(77, 1, "A new birch boiler of 99 litres.")], "doc_id long, page_no int, text string"))
    assert any(r["doc_id"] == 77 for r in e.search(q, "sparse").collect())
    e.build_indexes()
    assert any(r["doc_id"] == 77 for r in e.search(q, "sparse", approximate=True).collect())

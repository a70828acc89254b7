import pytest

from paperloom.operators.pages import pages_of_lines
from paperloom.sources.store import Store, list_documents, read_pdf_pages, write_csv
from paperloom.streaming.ingest import start, watch


def test_replace_rewrites_documents(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, t string")
    with pytest.raises(KeyError):
        s.read("x")
    assert s.read("x", "doc_id long, t string").count() == 0
    s.replace("x", rows((1, "a"), (1, "b"), (2, "c"), (3, "d")))
    s.replace("x", rows((1, "z"), (9, "n")))
    assert sorted((r["doc_id"], r["t"]) for r in s.read("x").collect()) == [(1, "z"), (2, "c"), (3, "d"), (9, "n")]
    assert [r["t"] for r in s.document("x", 1).collect()] == ["z"] and [r["doc_id"] for r in s.ids("x").collect()] == [1, 2, 3, 9]


def test_stream_ingests_and_replaces(spark, tmp_path):
    land, s = str(tmp_path / "land"), Store(spark, str(tmp_path / "s"), 4)
    docs = spark.createDataFrame([(1, "One sentence here. Another one follows."), (2, "Only this.")], "doc_id long, text string")
    page = lambda d: pages_of_lines(d).selectExpr("doc_id", "cast(page_no as int) page_no", "text")
    page(docs).write.parquet(land)
    run = lambda: start(watch(spark, land), s, str(tmp_path / "cp"), semantic=False).awaitTermination()
    run()
    assert s.read("chunks").count() == 2 and s.read("progress").where("stage = 'done'").count() == 2
    bad = spark.createDataFrame([(3, None, "x")], "doc_id long, page_no int, text string")
    page(spark.createDataFrame([(1, "Now it is new.")], "doc_id long, text string")).unionByName(bad).write.mode("append").parquet(land)
    run()
    got = {r["doc_id"]: r["text"] for r in s.read("chunks").collect()}
    assert got == {1: "Now it is new.", 2: "Only this."}
    assert s.read("progress").where("stage = 'error'").select("doc_id").first()[0] == 3
    assert s.read("postings").where("doc_id = 1 and term = 'new'").count() == 1


def test_lists_and_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\nb"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_pages"], r["n_chunks"]) for r in list_documents(d, pages_of_lines(d, 1), d.where("doc_id = 1")).collect()}
    assert got == {1: (2, 1), 2: (1, 0)}
    write_csv(d.select("doc_id"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    write_csv(spark.range(40).repartition(3), str(tmp_path / "m"), None)
    assert len(list((tmp_path / "m").glob("*.csv"))) == 3 and spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 40
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.PDF").write_bytes(b"%PDF one|two")
    (tmp_path / "p/b.pdf").write_bytes(b"no")
    pages = read_pdf_pages(spark, str(tmp_path / "p"), lambda b: [(t, 612.0, 792.0) for t in b[5:].decode().split("|")])
    assert [(r["page_no"], r["text"]) for r in pages.orderBy("page_no").collect()] == [(1, "one"), (2, "two")]


def rows_of(spark, *x):
    return spark.createDataFrame(list(x), "doc_id long, t string")


def test_a_small_change_writes_little(spark, tmp_path):
    """One document of a hundred: about one percent of the bytes, and nothing old is written again."""
    s = Store(spark, str(tmp_path / "s"))
    import random

    rng = random.Random(1)
    text = lambda: " ".join(str(rng.getrandbits(60)) for _ in range(400))
    s.replace("x", rows_of(spark, *[(i, text()) for i in range(300)]))
    s.replace("x", rows_of(spark, *[(i, text()) for i in (7, 999, 8)]))
    first, second = s.version()[1]["x"]
    assert second["bytes"] < 0.03 * first["bytes"]
    assert s.read("x").count() == 301 and s.document("x", 7).count() == 1


def test_versions_and_compaction(spark, tmp_path, monkeypatch):
    from paperloom.sources import store

    monkeypatch.setattr(store, "TIER", 99)
    s, want = Store(spark, str(tmp_path / "s"), 4), {}
    for step in range(5):
        new = {i: f"{step}" for i in range(step, 12, step + 1)}
        s.replace("x", rows_of(spark, *new.items()))
        want |= new
    s.replace("x", rows_of(spark, (3, "a"), (3, "b")), rows_of(spark, (3, ""), (4, ""), (55, "")))
    want.pop(4)
    want.pop(3)
    rows = sorted([*want.items(), (3, "a"), (3, "b")])
    got = lambda: sorted((r["doc_id"], r["t"]) for r in s.read("x").collect())
    assert got() == rows and len(s.version()[1]["x"]) == 6
    s.compact("x", 3)
    assert got() == rows and len(s.version()[1]["x"]) == 4 and s.document("x", 4).count() == 0
    s.compact("x")
    assert got() == rows and len(s.version()[1]["x"]) == 1
    s.vacuum()
    assert got() == rows and len(list((tmp_path / "s/x").iterdir())) == 1
    monkeypatch.setattr(store, "TIER", 3)
    for i in range(6):
        s.replace("y", rows_of(spark, (i, "y")))
    assert s.read("y").count() == 6 and len(s.version()[1]["y"]) < 4


def test_a_lost_writer_leaves_the_old_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    s.replace("x", rows_of(spark, (1, "a")))
    s.replace("y", rows_of(spark, (1, "a")))
    with pytest.raises(RuntimeError, match="lost"), s.transaction():
        s.replace("x", rows_of(spark, (1, "b"), (2, "b")))
        assert s.read("x").first()["t"] == "a"
        raise RuntimeError("lost")
    assert [r["t"] for r in s.read("x").collect()] == [r["t"] for r in s.read("y").collect()] == ["a"]
    with s.transaction():
        s.replace("x", rows_of(spark, (1, "b")))
        s.replace("y", rows_of(spark, (1, "b")))
    assert s.version()[0] == 3 and s.read("y").first()["t"] == "b"


def test_the_slower_writer_is_told(spark, tmp_path):
    from paperloom.sources.store import Conflict

    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    with pytest.raises(Conflict), a.transaction():
        a.replace("x", rows_of(spark, (1, "a")))
        b.replace("x", rows_of(spark, (1, "b")))
    assert [r["t"] for r in a.read("x").collect()] == ["b"]


def test_views_of_segments(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    s.replace("pages", rows_of(spark, (1, "a"), (2, "b")))
    s.replace("pages", rows_of(spark, (2, "c")).selectExpr("doc_id", "t", "1 as more"))
    s.bootstrap("paperloom_test")
    try:
        assert [(r[0], r[1]) for r in spark.sql("SELECT doc_id, t FROM paperloom_test.pages ORDER BY 1").collect()] == [(1, "a"), (2, "c")]
    finally:
        spark.sql("DROP DATABASE paperloom_test CASCADE")

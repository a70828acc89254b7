import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(cols, found, order):
    key = lambda r: tuple((x is None, x) for x in r)
    at = [cols.index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in found), key=key)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect(), sorted(cols)) == rows(cols, got.fetchall(), sorted(cols))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_llm_folders(tmp_path):
    """Without the subpackage and the pipeline the rest imports and has its queries."""
    import shutil

    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(catalog.QUERIES)


def test_engine(spark, tmp_path):
    from paperloom.plans.engine import Engine, Settings

    e = Engine(spark, Settings(str(tmp_path / "e"), 4, semantic=False))
    pages = spark.createDataFrame([(1, 1, "The alder boiler holds 30 litres. It was built in 1950."), (1, 2, "A second page tells of Acme Inc. and REST."), (2, 1, "The birch boiler holds 40 litres.")], "doc_id long, page_no int, text string")
    e.ingest(pages)
    q = spark.createDataFrame([(0, "How many litres does the birch boiler hold?")], "query_id int, query string")
    best = e.search(q, top_k=1).collect()
    assert best[0]["doc_id"] == 2 and best[0]["citations"][0]["page_no"] == 1
    assert e.search(q, top_k=1, doc_ids=[1]).first()["doc_id"] == 1
    assert {r["doc_id"] for r in e.search(q, top_k=2, doc_ids=[1, 2]).collect()} == {1, 2}
    nodes, edges = e.graph(1)
    assert nodes.count() >= 2 and edges.count() >= 1
    assert e.progress().first()["done"] and e.documents().count() == 2 and "chunks" in e.info()["tables"]
    assert [r["page_no"] for r in e.highlights("1:0000").collect()] == [1, 2]
    assert [r["page_no"] for r in e.highlights("1:0000", 2).collect()] == [2]
    assert e.chunks(spark.createDataFrame([("2:0000",), ("9:0000",)], "chunk_id string")).count() == 1
    assert all(r["pages"] and set(r["pages"]) <= {1, 2} for r in nodes.collect())
    e.register(spark.createDataFrame([(1, "a.pdf", b"%PDF")], "doc_id long, name string, content binary"))
    assert {r["doc_id"]: r["name"] for r in e.documents().collect()} == {1: "a.pdf", 2: None} and e.file(1).first()["content"] == b"%PDF"
    before = {t: e.store.read(t).count() for t in e.info()["tables"]}
    e.ingest(pages)
    assert {t: e.store.read(t).count() for t in e.info()["tables"]} == before
    with pytest.raises(KeyError):
        e.search(q, doc_ids=[77])
    with pytest.raises(ValueError):
        e.search(q, top_k=50)


def test_engine_with_an_embedder_and_words(spark, tmp_path):
    """A function in place of hashed features; rectangles of cited words; a chunk without a vector stops the batch."""
    from paperloom.operators.layout import WORDS
    from paperloom.plans.engine import Engine, Settings

    embed = lambda t: F.array(*[F.contains(F.lower(t), F.lit(x)).cast("float") for x in ("cat", "ship")])
    e = Engine(spark, Settings(str(tmp_path / "e"), 4, semantic=False, reranker="none"), embed=embed)
    words = lambda t: [(w, 10.0 * i, 20.0, 10.0 * i + 8, 30.0, t.index(w), t.index(w) + len(w)) for i, w in enumerate(t.split())]
    rows = [(d, 1, t, 600.0, 800.0, words(t)) for d, t in ((1, "Feline beasts, cats above all."), (2, "Vessels and a ship."))] + [(3, None, "lost", 1.0, 1.0, None), (3, 2, "too", 1.0, 1.0, None)]
    e.ingest(spark.createDataFrame(rows, f"doc_id long, page_no int, text string, width double, height double, words {WORDS}"))
    q = spark.createDataFrame([(0, "ship"), (1, "cat")], "query_id int, query string")
    best = {r["query_id"]: r for r in e.search(q, "dense", 1).collect()}
    assert (best[0]["doc_id"], best[1]["doc_id"]) == (2, 1)
    cited = best[0]["citations"][0]
    assert (cited["page_width"], cited["page_height"]) == (600.0, 800.0) and [tuple(r) for r in cited["rects"]] == [(0.0, 20.0, 38.0, 30.0)]
    assert sorted(r["text"] for r in e.store.read("failed").collect()) == ["lost", "too"] and {r["stage"] for r in e.store.read("progress").where("doc_id = 3").collect()} == {"error"}
    assert [r["stage"] for r in e.store.read("progress").where("doc_id = 1").orderBy("seq").collect()] == ["chunking", "embedding", "graphing", "done"]
    with pytest.raises(Exception, match="no embedding"):
        Engine(spark, Settings(str(tmp_path / "f"), 4, semantic=False), embed=lambda t: F.lit(None).cast("array<float>")).ingest(spark.createDataFrame([(1, 1, "A text.")], "doc_id long, page_no int, text string"))

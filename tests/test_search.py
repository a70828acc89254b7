import re
import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import blocks, embedding, graph, index, layout, search, tables
from paperloom.plans import catalog, evaluate
from paperloom.streaming import progress


def frame(spark, rows, types):
    return spark.createDataFrame(rows, types)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "the pump moves water and the pump hums"), (2, "a turbine turns in the wind"), (3, "turbine pump: a turbine that pumps"), (4, ""), (5, None)]
    return frame(spark, rows, "doc_id long, text string").cache()


def asked(spark, *texts):
    return frame(spark, list(enumerate(texts)), "query_id int, query string")


@pytest.mark.parametrize("kind", ["stemmed", "live", "space"])
def test_bm25_ranks_the_document_with_both_terms_first(spark, corpus, kind):
    found = search.bm25(index.build(corpus, "doc_id", kind), asked(spark, "turbine pump", "zzz", ""), 5).orderBy("rank").collect()
    first = {"stemmed": 3, "live": 3}.get(kind)
    assert {r["query_id"] for r in found} == {0}
    if first:
        assert found[0]["doc_id"] == first


def test_bm25_formula(spark, corpus):
    docs = [["the", "pump", "moves", "water", "and", "the", "pump", "hums"], ["a", "turbine", "turns", "in", "the", "wind"], ["turbine", "pump", "a", "turbine", "that", "pumps"], [], []]
    avg, n = sum(map(len, docs)) / 5 + 1e-5, 5
    want = {}
    for i, d in enumerate(docs, 1):
        s = 0.0
        for t in ("turbine", "pump"):
            df, tf = sum(t in x for x in docs), Counter(d)[t]
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s:
            want[i] = round(s, search.BM25_DECIMALS["live"])
    got = {r["doc_id"]: r["score"] for r in search.bm25(index.build(corpus, "doc_id", "live"), asked(spark, "turbine pump pump"), 5).collect()}
    assert got == pytest.approx(want)


def test_stemming_matches_inflected_queries(spark):
    docs = frame(spark, [(1, "These units operated for years")], "doc_id long, text string")
    i = index.build(docs, "doc_id", "stemmed")
    assert search.bm25(i, asked(spark, "unit operate"), 5).count() == 1 and search.bm25(i, asked(spark, "zzz"), 5).count() == 0


def test_scope_has_its_own_statistics(spark):
    rows = [(1, "pump water", "a"), (2, "pump pump", "b"), (3, "water", "b")]
    docs = frame(spark, rows, "doc_id long, text string, scope string")
    q = frame(spark, [(0, "pump", "a"), (1, "pump", "b")], "query_id int, query string, scope string")
    got = {r["query_id"]: (r["doc_id"], r["score"]) for r in search.bm25(index.build(docs, "doc_id", "live", "scope"), q, 5).collect()}
    alone = {r["doc_id"]: r["score"] for s in "ab" for r in search.bm25(index.build(docs.where(F.col("scope") == s), "doc_id", "live"), asked(spark, "pump"), 5).collect()}
    assert got == {0: (1, alone[1]), 1: (2, alone[2])}


def test_rank_fusion(spark):
    r = lambda *ids: frame(spark, [(0, k, i, 1.0) for i, k in enumerate(ids, 1)], "query_id int, key string, rank int, score double")
    one = search.reciprocal_rank_fusion([r("x")], "key").first()
    assert one["rrf"] == pytest.approx(1 / 61)
    two = {x["key"]: x["rrf"] for x in search.reciprocal_rank_fusion([r("x"), r("y", "x")], "key", 10, [2, 1]).collect()}
    assert two["x"] == pytest.approx(2 / 11 + 1 / 12) and two["x"] > two["y"]
    with pytest.raises(ValueError):
        search.reciprocal_rank_fusion([r("x")], "key", weights=[1, 2])


def test_fused_keeps_provenance_and_order_of_ties(spark):
    r = lambda *ids: frame(spark, [(0, k, i, 1.0) for i, k in enumerate(ids, 1)], "query_id int, key string, rank int, score double")
    got = search.fused(r("a", "b"), r("c", "b"), "key").orderBy("fused_rank").collect()
    assert [(x["key"], x["dense_rank"], x["sparse_rank"]) for x in got] == [("b", 2, 2), ("a", 1, None), ("c", None, 1)]


def test_hash_vectors_are_unit_and_alike_for_like_texts(spark):
    texts = frame(spark, [(0, "water pump with a valve"), (1, "a valve and a water pump"), (2, "opera singers"), (3, "the of")], "id int, text string")
    v = {r["id"]: np.array(r["embedding"]) for r in embedding.dense_vectors(texts, ["id"]).collect()}
    assert all(abs(np.linalg.norm(v[i]) - 1) < 1e-5 for i in (0, 1, 2)) and not v[3].any() and v[0] @ v[1] > v[0] @ v[2]
    got = search.hashed(texts, "id", asked(spark, "water pump valve"), 2).orderBy("rank").collect()
    q = embedding.dense_vectors(frame(spark, [(9, "water pump valve")], "id int, text string"), ["id"]).first()["embedding"]
    assert got[0]["score"] == pytest.approx(float(max(np.array(q) @ v[i] for i in v)), abs=2e-4)


def test_dense_vectors_are_the_sparse_ones(spark):
    rng = random.Random(5)
    words = ["pump", "valves", "the", "running", "é", "x1", "cities", "of", "pass"]
    texts = frame(spark, [(i, f"k{i}", " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(60)] + [(60, None, None), (61, "t", "the of"), (62, "u", "")], "id int, k string, text string")
    got = {r["id"]: r["embedding"] for r in embedding.dense_vectors(texts, ["id", "k"]).collect()}
    want = {i: [0.0] * 384 for i in got}
    for r in embedding.sparse_vectors(texts, ["id", "k"]).collect():
        want[r["id"]][r["bucket"]] = r["value"]
    assert len(got) == 63 and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)
    # neighbours of a document, cut between slices of texts as elsewhere
    rows = [(i % 2, i // 2, t) for i, t in enumerate(rng.choices(["pump valve", "valve pump x", "", "other words here"], k=3000))]
    near = {(r["doc_id"], r["sent_no"]): r["similarity"] for r in embedding.neighbour_cosine(frame(spark, rows, "doc_id int, sent_no int, text string")).collect()}
    unit = {(r["doc_id"], r["sent_no"]): np.array(r["embedding"]) for r in embedding.dense_vectors(frame(spark, rows, "doc_id int, sent_no int, text string"), ["doc_id", "sent_no"]).collect()}
    assert near.keys() == {(d, i) for d, i in unit if (d, i + 1) in unit}
    assert all(abs(near[d, i] - unit[d, i] @ unit[d, i + 1]) < 1e-6 for d, i in near)


def test_dense_and_its_blocks_agree(spark, monkeypatch):
    rng = random.Random(1)
    v = frame(spark, [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    ask = lambda: search.dense(v, q, top=7)
    a = ask().orderBy("query_id", "rank").collect()
    x = {r["vec_id"]: np.array(r["embedding"]) for r in v.collect()}
    want = [(i, k) for i in range(5) for k in sorted(x, key=lambda k: (-round(float(x[i] @ x[k]), 4), k))[:7]]
    assert [(r["query_id"], r["vec_id"]) for r in a] == want
    # blocks of a few rows, sent to all tasks or dealt
    monkeypatch.setattr(blocks, "ROWS", 3)
    assert ask().orderBy("query_id", "rank").collect() == a
    monkeypatch.setattr(blocks, "BROADCAST", 0)
    dealt = ask()
    assert "strategy=broadcast" not in dealt._jdf.queryExecution().optimizedPlan().toString() and dealt.orderBy("query_id", "rank").collect() == a


def test_lexical_score(spark):
    score = lambda q, t: frame(spark, [(q, t)], "q string, t string").select(search.lexical_score(F.col("q"), F.col("t")).alias("s")).first()["s"]
    assert score("water pump", "the water pump") == 1.5 and score("water pump", "pump water") == 1.0 and score("the", "x") == 0.0


def test_hybrid_modes(spark, corpus):
    i, q = index.build(corpus, "doc_id", "live"), asked(spark, "turbine pump")
    for mode in ("hybrid", "dense", "sparse"):
        for rerank in (True, False):
            got = search.hybrid(corpus, "doc_id", i, q, 2, mode=mode, rerank=rerank).orderBy("rank").collect()
            assert got[0]["doc_id"] == 3 and (got[0]["dense_rank"] is None) == (mode == "sparse")
    with pytest.raises(ValueError):
        search.hybrid(corpus, "doc_id", i, q, mode="other")


def test_post_filter_and_floor(spark):
    r = frame(spark, [(0, d, d, 1.0 / d) for d in range(1, 6)], "query_id int, doc_id long, rank int, score double")
    got = search.in_documents(r, frame(spark, [(2,), (4,), (5,)], "doc_id long"), 2).orderBy("rank").collect()
    assert [(x["doc_id"], x["rank"]) for x in got] == [(2, 1), (4, 2)]
    assert search.in_documents(r, None, 3).count() == 3 and search.above(r, 0.3).count() == 3


@pytest.mark.parametrize("mode", ["hybrid", "sparse", "dense"])
def test_a_part_of_a_passage_finds_it(spark, mode):
    """Eight words from the middle of each benchmark passage, against all passages: nine of ten come first, at least."""
    passages = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    words = F.split("text", " ")
    q = passages.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, F.greatest((F.size(words) / 2).cast("int") - 4, F.lit(1)), F.lit(8)), " ").alias("query"))
    found = search.hybrid(passages, "doc_id", index.build(passages, "doc_id", "live"), q, 3, mode=mode)
    score = evaluate.hits(found, q.select("query_id", F.col("query_id").alias("doc_id")), q).first()
    assert score["n"] == 40 and score["hit_1"] >= 0.9 and score["mrr"] >= score["hit_1"]


def test_citations_of_missing_pages(spark):
    spans = frame(spark, [("c", 1, 1, 2, 5), ("c", 1, 9, 0, 3)], "chunk_id string, doc_id long, page_no int, span_start int, span_end int")
    pages = frame(spark, [(1, 1, "abcdefg")], "doc_id long, page_no int, text string")
    got = {r["page_no"]: r["text"] for r in search.citations(spans, pages).collect()}
    assert got == {1: "cde", 9: ""}
    assert search.page_label(search.citations(spans, pages)).first()["label"] == "Pages 1-9"
    assert search.best_page_by_length(spans).first()["page_no"] == 1


def test_upsert_replaces_whole_documents(spark):
    old = frame(spark, [(1, "a"), (1, "b"), (2, "c")], "doc_id long, t string")
    assert sorted(r["t"] for r in index.upsert(old, frame(spark, [(1, "z")], "doc_id long, t string")).collect()) == ["c", "z"]
    with pytest.raises(Exception, match="no embedding"):
        index.with_embeddings(frame(spark, [(1, None)], "doc_id long, embedding array<float>")).collect()


def test_entities(spark):
    text = "GraphNet uses Self-Attention Mechanism. Dr. Smith of Acme Inc. met REST and GPT-4. graphnet and REST again, cross-attention."
    e = {r["key"]: r for r in graph.entities(frame(spark, [(1, 0, text), (1, 1, "REST only")], "doc_id long, chunk_no int, text string")).collect()}
    assert e["graphnet"]["etype"] == "TECH" and e["self-attention mechanism"]["etype"] == "CONCEPT" and e["cross-attention"]["etype"] == "TECH"
    assert e["rest"]["freq"] == 6 and e["rest"]["df"] == 2 and e["gpt-4"]["text"] == "GPT-4"
    assert e["rest"]["score"] == pytest.approx(6 / 2 * (math.log(3 / 3) + 1))


def test_graph_edges_and_views(spark):
    chunks = frame(spark, [(1, i, "Alpha Beta; Gamma" if i else "Alpha Beta; Gamma; Delta") for i in range(3)], "doc_id long, chunk_no int, text string")
    top = graph.top_entities(graph.entities(chunks))
    edges = graph.edges(graph.cooccurrences(chunks, top))
    w = sorted(r["weight"] for r in edges.collect())
    assert w == [0.333, 0.333, 1.0]
    nodes = graph.nodes(top)
    assert graph.visible_edges(edges, graph.filter_nodes(nodes, ["TERM", "CONCEPT"], "a")).count() == 3
    assert graph.visible_edges(edges, graph.filter_nodes(nodes, ["TERM"], "gam")).count() == 0
    assert graph.neighbours(edges).count() == 6 and graph.type_counts(nodes).agg(F.sum("n")).first()[0] == 3
    keyed = frame(spark, [(1, 0, "Python, REST; Next.js Python (Docker)")], "doc_id long, chunk_no int, text string")
    assert {r["key"]: r["freq"] for r in graph.keyword_nodes(keyed).collect()} == {"Python": 2, "REST": 1, "Next.js": 1, "Docker": 1}
    assert graph.keyword_edges(keyed, True).count() == 6


def test_lines_follow_the_running_top(spark):
    word = "struct<text:string,x0:double,y0:double,x1:double,y1:double,start:int,end:int>"
    tops = [10.0, 12.9, 8.0, 11.5, 20.0]
    words = [("w", 10.0 * i, y, 10.0 * i + 5, y + 10, 5 * i, 5 * i + 4) for i, y in enumerate(tops)]
    df = frame(spark, [(words,)], f"words array<{word}>")
    got = df.select(layout.line_rects(F.col("words")).alias("r")).first()["r"]
    assert [tuple(r) for r in got] == [(0.0, 8.0, 25.0, 22.9), (30.0, 11.5, 35.0, 21.5), (40.0, 20.0, 45.0, 30.0)]
    part = df.select(layout.line_rects(layout.overlapping(F.col("words"), F.lit(5), F.lit(10))).alias("r")).first()["r"]
    assert [tuple(r) for r in part] == [(10.0, 12.9, 15.0, 22.9)]
    s = df.select(layout.scaled(layout.line_rects(F.col("words")), F.lit(100.0), F.lit(200.0)).alias("r")).first()["r"][0]
    assert (s["left"], s["top"], s["width"], s["height"]) == pytest.approx((-1.0, 15.0, 52.0, 31.8))
    assert df.select(layout.clamp_page(F.lit(9), F.lit(4)).alias("p")).first()["p"] == 4


def test_tables(spark):
    rows = [(1, 1, 1, [["Name", " Unit \n price", "Name"], ["a", "1", "x"], [None, "", None], ["b"]]), (1, 2, 1, [["Other"], ["z"]]), (1, 3, 1, [])]
    t = frame(spark, rows, "doc_id long, page_no int, table_no int, rows array<array<string>>")
    assert [(r["column"], r["place"]) for r in tables.columns(t).orderBy("place").collect()] == [("Name", 1), ("Unit price", 2), ("Other", 3)]
    got = tables.project(t, ["Unit price", "Name", "None"]).orderBy("page_no", "row_no").collect()
    assert [(r["Unit price"], r["Name"], r["None"]) for r in got] == [("1", "a", ""), ("", "b", "")]
    with pytest.raises(ValueError):
        tables.project(t, [])
    assert [r["cells"] for r in tables.sheet(t).orderBy("line_no").collect()][:5] == [["Name", " Unit \n price", "Name"], ["a", "1", "x"], ["", "", ""], ["b"], []]
    assert tables.mask(t, ["NAME"]).where("page_no = 1").first()["rows"][1] == [None, "1", None]


def test_progress(spark):
    rows = [("b", 1, 1, "queued", 0, 0, None), ("b", 1, 2, "embedding", 1, 2, None), ("b", 2, 1, "done", 0, 0, None), ("c", 3, 1, "error", 0, 0, "bad"), ("c", 4, 1, "error", 0, 0, None)]
    e = frame(spark, rows, "batch_id string, doc_id long, seq long, stage string, processed int, total int, error string")
    got = {r["batch_id"]: r for r in progress.snapshot(e).collect()}
    assert (got["b"]["done"], got["b"]["pct"], got["c"]["done"], got["c"]["pct"]) == (False, 80.0, True, 0.0)
    assert {r["batch_id"]: (r["done_docs"], r["error"]) for r in progress.outcome(e).collect()} == {"b": (1, None), "c": (0, "bad")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sums_in_place(df):
    """Whether what queries make of a text is summed where its postings lie, not shuffled by query and text."""
    return not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", _plan(df))


@pytest.mark.parametrize("scope", [None, "source"])
def test_scores_of_queries_are_not_shuffled(spark, tmp_path, scope):
    frame(spark, [(1, "pump valve", "a"), (2, "valve gasket", "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    asked = frame(spark, [(1, "valve pump", "a"), (2, "gasket", "b")], "query_id long, query string, source string")
    assert _sums_in_place(search.bm25(index.build(texts, "doc_id", "live", scope), asked, 3))


def test_overlaps_of_queries_are_not_shuffled(spark, tmp_path):
    frame(spark, [(1, "pump valve"), (2, "valve gasket")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    found = search.overlap_search(spark.read.parquet(f"{tmp_path}/t"), "doc_id", frame(spark, [(1, "valve pump")], "query_id long, query string"), 3)
    assert _sums_in_place(found) and [r["doc_id"] for r in found.orderBy("rank").collect()] == [1, 2]


def test_neighbour_cosine_goes_on_over_batches(spark):
    rows = [(d, s, f"alpha beta {'gamma' if s % 2 else 'delta'} w{d}") for d in (1, 2) for s in range(9)]
    near = lambda: embedding.neighbour_cosine(frame(spark, rows, "doc_id int, sent_no int, text string"))
    whole, key = sorted(map(tuple, near().collect())), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        assert sorted(map(tuple, near().collect())) == whole and len(whole) == 16
    finally:
        spark.conf.set(key, before)
    # no call of Python for each document
    assert "FlatMapGroupsInArrow" not in _plan(near())


@pytest.mark.parametrize("kind", ["live", "stemmed", "space"])
def test_texts_are_read_once_for_few_queries(spark, monkeypatch, kind):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(3000)] + ["the", "valves", "running", "parties", "Ünits"]
    texts = frame(spark, [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(300 + i, "w1 w2 valves") for i in range(20)] + [(400, None), (None, "w1 w2")], "doc_id long, text string").cache()
    asked = frame(spark, [(1, "w1 w2 valves"), (None, "w3 the"), (3, ""), (4, None), (5, "absent Ünits"), (6, "w1 w1")], "query_id long, query string")
    built = index.build(texts, "doc_id", kind)
    for size in (7, 4096):
        monkeypatch.setattr(search, "TEXTS", size)
        monkeypatch.setattr(search, "CELLS", size)
        monkeypatch.setattr(search, "QUERIES", 2)
        found = search.bm25(built, asked, 5)
        assert "MapInArrow" in _plan(found) and "Join" not in _plan(found)
        plain = search.bm25(replace(built, texts=None), asked, 5)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))


def test_hashed_vectors_are_packed_at_once(spark):
    found = search.hashed(frame(spark, [(1, "pump valve"), (2, "valve"), (None, "valve"), (3, None)], "doc_id long, text string"), "doc_id", frame(spark, [(1, "valve")], "query_id long, query string"), 3)
    assert "exists" not in _plan(found).split("BroadcastExchange")[0] and [r["doc_id"] for r in found.orderBy("rank").collect()] == [2, 1, 3]


@pytest.mark.parametrize("kind", ["live", "stemmed"])
def test_scoped_scores_are_summed_in_blocks_of_texts(spark, monkeypatch, kind):
    """No postings of a scoped index are joined with queries, however many of few terms these are; the ranking is that of the join."""
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(3000)] + ["the", "valves", "running"]
    scopes = ["a", "b/c", "", "ü", None]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(scopes)) for i in range(300)] + [(300 + i, "w1 w2 valves", "a") for i in range(20)] + [(400, None, "a"), (None, "w1 w2", "a"), (5, "w1 the", "alone")]
    texts = frame(spark, rows, "doc_id long, text string, source string").cache()
    asked = frame(spark, [(f"{i}/{s}", q, s) for i, q in enumerate(["w1 w2 valves", "w3 the", "", "absent running", "w1 w1"]) for s in [*scopes, "alone", "absent"]], "query_id string, query string, source string")
    built = index.build(texts, "doc_id", kind, "source")
    want = sorted(map(repr, search.bm25(replace(built, texts=None), asked, 3).collect()))
    assert len(want) > 20
    for few, size in ((1 << 17, 4096), (12, 7)):
        with monkeypatch.context() as m:
            for name, value in (("FEW", few), ("TEXTS", size), ("CELLS", size), ("QUERIES", 2)):
                m.setattr(search, name, value)
            found = search.bm25(built, asked, 3)
            assert "Join" not in _plan(found) and sorted(map(repr, found.collect())) == want


def test_scoped_query_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    texts = [" ".join(rng.choices("pump valve gasket wind turbine é x1 der the".split(), k=rng.randint(0, 12))) for _ in range(80)]
    frame(spark, [(i, x or None, rng.choice(["a", "b/c", "/", None])) for i, x in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(i, texts[i]) for i in range(9)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(catalog.oracles()["bm25_scoped_topk"]).fetchall())
    got = sorted(map(tuple, catalog.bm25_scoped_topk(spark, str(tmp_path)).collect()))
    assert len(want) > 30 and [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want])

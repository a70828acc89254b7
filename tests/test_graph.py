from paperloom.operators import graph

TYPES = "doc_id long, source string, target string, weight double"


def test_neighbours_read_edges_once(spark):
    out = graph.neighbours(spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 0.5)], TYPES))
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "c", "b")]


def test_pairs_of_a_chunk_are_made_in_its_row(spark):
    chunks = spark.createDataFrame([(1, 0, "Alpha Beta and GammaDelta with XYZ9"), (1, 1, "XYZ9 and GammaDelta"), (2, 0, "XYZ9")], "doc_id long, chunk_no int, text string")
    found = graph.mentions(chunks).cache()
    top = graph.top_entities(graph.entities(chunks, found))
    pairs = graph.cooccurrences(chunks, top, found)
    keys = {(r["doc_id"], r["chunk_no"], r["key"]) for r in found.collect()}
    want = {(d, a, b) for d, c, a in keys for e, f, b in keys if (d, c) == (e, f) and a < b}
    assert {(r["doc_id"], r["source_key"], r["target_key"]) for r in pairs.collect()} == want and want
    # the inner join is that of entities with chunk counts; a chunk's entities are not joined with each other
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") <= 1

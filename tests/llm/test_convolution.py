import numpy as np
import pytest

from paperloom.llm import convolution as C

SMALL = C.Shape(chunk=32, overlap=8, filters=4, hidden=3)


def test_gradient_by_differences():
    net = C.Network(SMALL, 1)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    net.p["b"] += 0.1
    texts, labels, weights = [b"hello world this is a longer text that spans chunks", b"###!!", b""], np.array([True, False, True]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradient(texts, labels, weights)
    rng = np.random.default_rng(0)
    for k, x in net.p.items():
        for _ in range(5):
            i = tuple(rng.integers(0, n) for n in x.shape)
            i = (ord("l"), i[1]) if k == "e" else i
            old, losses = x[i], []
            for h in (1e-5, -1e-5):
                x[i] = old + h
                losses.append(net.gradient(texts, labels, weights)[0])
            x[i] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[k][i], abs=1e-6)


def plain(net: C.Network, raw: bytes) -> float:
    """The network's formula, place by place."""
    s, p = net.shape, net.p
    symbols = list(raw) + [C.PAD] * (s.chunk - len(raw))
    starts, at = [], 0
    while at < len(symbols) - s.chunk:
        starts.append(at)
        at += s.chunk - s.overlap
    features = []
    for at in [*starts, len(symbols) - s.chunk]:
        cut = symbols[at : at + s.chunk]
        seen = [np.concatenate([p["e"][c] for c in cut[i : i + s.width]]) @ p["w"] for i in range(0, s.chunk - s.width + 1, s.step)]
        top = np.maximum(np.max(seen, axis=0) + p["b"], 0)
        features.append(np.maximum(top @ p["u"] + p["c"], 0))
    z = np.concatenate([np.max(features, axis=0), np.mean(features, axis=0)]) @ p["v"] + p["d"]
    return float(1 / (1 + np.exp(-z[0])))


def test_scores_of_whole_texts_by_the_formula():
    net = C.Network(SMALL, 3)
    texts = [b"", b"a", bytes(range(256)), b"word " * 500, b"x" * 32, b"x" * 33, b"end" + b"y" * 61]
    for block in (1, 3, 512):
        assert net.score(texts, block) == pytest.approx([plain(net, t) for t in texts], abs=1e-5)


def test_the_end_of_a_long_text_counts():
    net = C.Network(C.Shape(), 5)
    a, b = net.score([b"abc " * 20_000, b"abc " * 19_990 + b"#$%&" * 10])
    assert a != b


def test_learns_labels_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in C.QUERIES["op12_byte_convolution"](spark, sf).collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(got) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    labels = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    held = [(r["predicted"], q) for r, q in labels if r["held_out"]]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95


def test_held_out_labels_change_nothing(spark):
    rows = [(i, ("good words here. " if i % 3 else "### !!! &&& ") * (1 + i % 5)) for i in range(60)]
    docs, some = spark.createDataFrame(rows, "doc_id long, text string"), C.Training(steps=20, epochs=1)
    import zlib

    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    scores = lambda wrong: [r["score"] for r in C.quality_scores(docs, spark.createDataFrame([(d, int(d % 3 > 0) ^ (wrong and out(d))) for d, _ in rows] + [(None, 1), (1, None), (999, 0), (2, 7)], "doc_id long, quality int"), some).orderBy("doc_id").collect()]
    assert scores(False) == scores(True)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, "t" * (i % 7 + 1)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert C.sample(docs, labels, C.Training(rows=10)).count() == 10
    few = C.sample(docs, labels, C.Training(nbytes=50)).collect()
    assert few and sum(len(r["text"]) for r in few) <= 50
    assert C.quality_scores(docs, labels.limit(0)).count() == 400

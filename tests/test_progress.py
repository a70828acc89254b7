import random
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom.operators import embedder
from paperloom.plans.engine import Engine, Settings
from paperloom.streaming import progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])
EVENTS = "batch_id long, doc_id long, seq long, stage string, processed int, total int, error string"


def test_stream_equals_tables_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(b, d, s, rng.choice(progress.STAGES), rng.randint(0, 5), rng.choice([0, 5]), None) for b in range(3) for d in range(6) for s in range(5)]
    rows = [(*r[:6], f"bad {r[1]}" if r[3] == "error" else None) for r in rows] + [(9, 1, 0, "queued", 0, 1, None), (9, 1, 4, "done", 1, 1, None), (9, 2, 1, "error", 1, 1, "lost")]
    rng.shuffle(rows)
    for i in range(0, len(rows), 31):
        spark.createDataFrame(rows[i : i + 31], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with progress.rocksdb(spark):
        told = progress.snapshots(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        told.writeStream.outputMode("update").foreachBatch(lambda x, _: x.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    events = spark.createDataFrame(rows, EVENTS)
    want = {r["batch_id"]: tuple(r) for r in progress.snapshot(events).join(progress.outcome(events), "batch_id").collect()}
    last = out.groupBy("batch_id").agg(F.max_by(F.struct("docs", "done", "pct", "done_docs", "error"), "seen").alias("s")).select("batch_id", "s.*")
    assert {r["batch_id"]: tuple(r) for r in last.collect()} == want and want[9][2] is True
    assert out.count() > len(want)


class Counting:
    """A model that notes the sizes of its batches, and how often it was loaded, in a folder."""

    def __init__(self, folder, wait=0.0):
        self.folder, self.wait = folder, wait

    def __call__(self):
        folder, wait = self.folder, self.wait
        with open(f"{folder}/loads", "a") as f:
            f.write("x")

        def model(texts):
            with open(f"{folder}/sizes", "a") as f:
                f.write(f"{len(texts)} ")
            time.sleep(wait)
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)

        return model


def test_batches_are_full_whatever_arrow_makes(spark, tmp_path):
    texts = spark.range(100).select("id", F.when(F.col("id") != 50, F.concat(F.lit("a"), F.col("id").cast("string"))).alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["id"]: r["embedding"] for r in embedder.embedded(texts, ["id"], Counting(str(tmp_path)), "counting").collect()}
        embedder.embedded(texts, ["id"], Counting(str(tmp_path)), "counting").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[7] == [2.0, 1.0] and got[50] is None and len(got) == 100
    sizes = list(map(int, (tmp_path / "sizes").read_text().split()))
    assert sizes == [32, 31, 32, 4] * 2 and len((tmp_path / "loads").read_text()) <= 2
    with pytest.raises(Exception, match="vectors for"):
        embedder.embedded(texts, ["id"], lambda: lambda t: np.zeros((1, 2)), "wrong").collect()


def test_fractions_and_a_feed_while_a_batch_runs(spark, tmp_path):
    e = Engine(spark, Settings(str(tmp_path / "e"), 4, semantic=False, reranker="none", embed_steps=4), model=Counting(str(tmp_path), 0.05))
    pages = spark.createDataFrame([(d, 1, f"Document {d} of cats. It has a few words.") for d in range(12)], "doc_id long, page_no int, text string")
    failed = []

    def run():
        try:
            e.ingest(pages, 5)
        except Exception as x:  # noqa: BLE001
            failed.append(x)

    t = threading.Thread(target=run)
    t.start()
    seen = list(e.watch(5, most=120))
    t.join()
    assert not failed and seen[-1]["done"] and seen[-1]["pct"] == 100.0
    assert len(seen) >= 3 and not seen[0]["done"] and all(a["pct"] <= b["pct"] for a, b in zip(seen, seen[1:]))
    told = [(r["stage"], r["processed"], r["total"]) for r in e.store.read("progress").where("doc_id = 3").orderBy("seq").collect()]
    assert told == [("chunking", 1, 1), *[("embedding", k, 4) for k in range(5)], ("graphing", 1, 1), ("done", 1, 1)]
    assert e.store.read("vectors").count() == 12
    best = e.search(spark.createDataFrame([(0, "Document 3 of cats. It has a few words.")], "query_id int, query string"), "dense", 1).first()
    assert best["score"] > 0


def test_a_document_that_cannot_be_embedded_does_not_stop_the_others(spark, tmp_path):
    """The model raises on some texts: their documents fail, as they were in the store before; a model that raises on all stops the batch."""

    def load(bad):
        def model(texts):
            if any(bad in t for t in texts):
                raise ValueError("this text is too much")
            return np.array([[len(t), 1] for t in texts], np.float32)

        return lambda: model

    pages = lambda *rows: spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    e = Engine(spark, Settings(str(tmp_path / "e"), 4, semantic=False, reranker="none", embed_steps=2), model=load("poison"))
    e.ingest(pages((1, 1, "An old text of one."), (2, 1, "An old text of two.")), 1)
    e.ingest(pages((1, 1, "A new text with poison."), (2, 1, "A new text of two."), (3, 1, "Three."), (4, None, "no number")), 2)
    assert {r["doc_id"]: r["text"] for r in e.store.read("chunks").collect()} == {1: "An old text of one.", 2: "A new text of two.", 3: "Three."}
    assert {r["doc_id"] for r in e.store.read("vectors").collect()} == {1, 2, 3} == {r["doc_id"] for r in e.store.read("lengths").collect()}
    failed = {r["doc_id"]: r["error"] for r in e.store.read("failed").where("batch_id = 2").collect()}
    assert failed == {1: "a chunk without an embedding", 4: "a page without a number or a document"}
    last = {r["doc_id"]: r["stage"] for r in progress.latest(e.store.read("progress").where("batch_id = 2")).collect()}
    assert last == {1: "error", 2: "done", 3: "done", 4: "error"}
    with pytest.raises(Exception, match="no embedding"):
        Engine(spark, Settings(str(tmp_path / "f"), 4, semantic=False), model=load(" ")).ingest(pages((1, 1, "Any text."), (2, 1, "Any other.")), 1)

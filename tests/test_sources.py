import sqlite3
import struct

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import sys

from paperloom.sources import page_slices, upsert

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Tiny:
    """A container of its own: the number of pages, where each begins, then their texts."""

    @staticmethod
    def write(path, texts, bad=()):
        raw, at = [t.encode() for t in texts], 4 + 8 * len(texts)
        with open(path, "wb") as f:
            f.write(struct.pack("<I", len(raw)))
            for i, t in enumerate(raw):
                f.write(struct.pack("<II", at if i not in bad else 2**32 - 1, len(t)))
                at += len(t)
            f.writelines(raw)

    def count(self, file):
        return struct.unpack("<I", file.read(4))[0]

    def pages(self, file, first, last, text):
        for i in range(first - 1, last):
            file.seek(4 + 8 * i)
            at, n = struct.unpack("<II", file.read(8))
            if at == 2**32 - 1:
                raise ValueError(f"page {i + 1} was read")
            if text:
                file.seek(at)
            yield file.read(n).decode() if text else None, 612.0, 792.0


@pytest.fixture()
def files(spark, tmp_path):
    Tiny.write(tmp_path / "a.tiny", [f"page {i} of a" if i != 7 else " \n" for i in range(1, 48)])
    Tiny.write(tmp_path / "b.tiny", ["one", "two"], bad=(1,))
    Tiny.write(tmp_path / "none.tiny", [])
    (tmp_path / "other.txt").write_bytes(b"x")
    page_slices.register(spark, Tiny(), "tiny")
    return spark.read.format("tiny").option("path", f"{tmp_path}/*.tiny").option("slice", 10)


def test_slices_of_a_file_are_partitions(files, tmp_path):
    a = files.load().where(F.col("path") == f"{tmp_path}/a.tiny")
    rows = a.withColumn("task", F.spark_partition_id()).orderBy("page_no").collect()
    assert [r["page_no"] for r in rows] == list(range(1, 48)) and rows[41]["text"] == "page 42 of a"
    assert len({r["task"] for r in rows}) == 5 and len({(r["task"], (r["page_no"] - 1) // 10) for r in rows}) == 5
    assert [r["warning"] for r in rows if r["warning"]] == ["page 7: no extractable text"] and rows[6]["text"] == " \n"


def test_filters_skip_slices_and_files(files, tmp_path):
    with pytest.raises(Exception, match="page 2 was read"):
        files.load().collect()
    some = files.load().where("page_no = 1")
    assert some.rdd.getNumPartitions() == 2 and sorted(r["text"] for r in some.collect()) == ["one", "page 1 of a"]
    few = files.load().where("page_no > 18 and page_no <= 22")
    assert few.rdd.getNumPartitions() == 2 and [r["page_no"] for r in few.orderBy("page_no").collect()] == [19, 20, 21, 22]
    assert sorted(r["page_no"] for r in files.load().where("page_no in (5, 33) and width > 1").collect()) == [5, 33]
    assert files.load().where("page_no > 500").count() == 0


def test_without_text_none_is_read(files):
    sizes = files.schema("path string, page_no int, width double").load()
    assert sizes.where("page_no = 3").first()["width"] == 612.0 and sizes.columns == ["path", "page_no", "width"]


@pytest.fixture()
def database(tmp_path):
    path = str(tmp_path / "d.sqlite")
    connect = lambda: sqlite3.connect(path, timeout=60)
    upsert.prepare(connect, "chunks", {"id": "BIGINT", "part": "BIGINT", "t": "TEXT"}, ["id", "part"])
    table = lambda name: sorted(connect().execute(f"SELECT * FROM {name}").fetchall())
    return connect, table


def test_keys_are_there_once(spark, database):
    connect, table = database
    put = lambda rows, batch: upsert.upsert(spark.createDataFrame(rows, "id long, part long, t string"), connect, "chunks", ["id", "part"], batch)
    put([(i, 0, f"a{i}") for i in range(1200)], "1")
    put([(3, 0, "new"), (5000, 1, None)], "2")
    want = sorted([(i, 0, f"a{i}" if i != 3 else "new") for i in range(1200)] + [(5000, 1, None)])
    assert table("chunks") == want
    put([(3, 0, "replayed"), (5001, 1, "replayed")], "2")
    assert table("chunks") == want and table("chunks_staged") == [] and table("chunks_batches") == [("1",), ("2",)]
    with pytest.raises(Exception, match="null in the key"):
        put([(None, 0, "x")], "3")
    assert table("chunks") == want and table("chunks_staged") == []


def test_a_failed_task_leaves_nothing(spark, database):
    connect, table = database
    rows = spark.range(200).select("id", F.lit(0).cast("long").alias("part"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.lit("t")).alias("t"))
    with pytest.raises(Exception, match="lost"):
        upsert.upsert(rows, connect, "chunks", ["id", "part"], "9")
    assert table("chunks") == [] and table("chunks_staged") == []
    upsert.upsert(rows.where("id <> 150"), connect, "chunks", ["id", "part"], "9")
    assert len(table("chunks")) == 199


def test_rows_of_a_doubled_attempt_do_not_count(database):
    from pyspark.sql.types import StructType

    connect, table = database
    schema = StructType.fromDDL("id long, part long, t string")
    w = upsert._Writer(connect, {"table": "chunks", "key": "id,part", "batch": "b"}, schema, "?")
    w.write(iter([(1, 1, "first attempt"), (2, 1, "only there")]))
    second = w.write(iter([(1, 1, "second attempt")]))
    w.commit([second])
    assert table("chunks") == [(1, 1, "second attempt")] and table("chunks_staged") == []

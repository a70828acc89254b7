"""Tables of an index in a folder: Parquet, in segments, replaced document by document and merged on read."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def settled(spark: SparkSession) -> SparkSession:
    """The session with one setting off: a union that passes its inputs' partitioning on can fail where adaptive execution
    gives them unequal numbers of partitions."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path within the one that all machines share, `spark.checkpoint.dir`; on a local master, where there may be none, a temporary one."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(given or tempfile.mkdtemp(prefix='paperloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_made: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to scratch and read back: what is used several times is made once, and its size is known to joins. The table goes when
    the driver's interpreter ends."""
    spark = settled(df.sparkSession)
    path = scratch(spark, name)
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_made):
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is already gone
            return


#: What an ingested corpus consists of.
TABLES = ("files", "pages", "chunks", "postings", "lengths", "vectors", "nodes", "edges", "progress", "failed")


#: Segments of a table that are merged when they are the newest and no older one is much larger.
TIER = 4


class Conflict(RuntimeError):
    """Another writer has made a version meanwhile."""


class Store:
    """Tables under a path, each a list of segments. Replacing documents adds a segment with their new rows and the ids that it decides;
    older segments are not touched. A reader drops rows whose id a newer segment decides.

    A version names the segments of all tables; it is a file that is there whole or not at all, and the newest counts. Until it is
    written, what a writer has made is not seen, so a lost writer leaves the version before. Rows of a segment lie
    sorted by a hash of their id, the bucket, so that a document is found by statistics of files and row groups. Newest segments
    of like size are merged, as often as a table doubles: an id is written again some log2(n) times in all.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = settled(spark), path.rstrip("/"), buckets
        self._open: dict[str, list[dict]] | None = None

    # --- files ---

    def _fs(self, where: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _bytes(self, where: str) -> int:
        fs, p = self._fs(where)
        return fs.getContentSummary(p).getLength()

    def has(self, where: str) -> bool:
        fs, p = self._fs(where)
        return fs.exists(p)

    def aside(self, rows: DataFrame) -> str:
        """Writes rows under a name of their own, to be read again and removed."""
        path = f"{self.path}/.aside-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # --- versions ---

    def version(self) -> tuple[int, dict[str, list[dict]]]:
        """The newest version's number and, for each table, its segments (id, key, bytes), oldest first; 0 and none at first."""
        fs, folder = self._fs(f"{self.path}/_versions")
        numbers = [int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(folder) if x.getPath().getName()[0] not in "._"] if fs.exists(folder) else []
        if not numbers:
            return 0, {}
        stream = fs.open(self._fs(f"{self.path}/_versions/{max(numbers)}.json")[1])
        try:
            return max(numbers), json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, before: int, tables: dict[str, list[dict]]) -> None:
        """Writes the next version aside and gives it its name, which fails where another writer was faster."""
        jvm, temporary = self.spark.sparkContext._jvm, f"{self.path}/_versions/.{uuid.uuid4().hex}"
        fs, p = self._fs(temporary)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(p), fs.makeQualified(self._fs(f"{self.path}/_versions/{before + 1}.json")[1]), none)
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {before + 1} is there already") from None
            raise

    @contextlib.contextmanager
    def transaction(self):
        """What is replaced within becomes visible at its end, all at once, or not at all. Tables are read as they were before."""
        if self._open is not None:
            yield
            return
        before, tables = self.version()
        self._open = {}
        try:
            yield
            added = self._open
        finally:
            self._open = None
        if added:
            self._commit(before, tables | {name: tables.get(name, []) + segments for name, segments in added.items()})
            for name in added:
                self._tidy(name)

    def _segments(self, name: str) -> list[dict]:
        return self.version()[1].get(name, [])

    def exists(self, name: str) -> bool:
        return bool(self._segments(name))

    # --- writing ---

    def _bucketed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _written(self, name: str, rows: DataFrame, ids: DataFrame, key: str) -> dict:
        """A new segment's entry. Its files follow from the size of what is written, as adaptive execution joins small parts."""
        segment = uuid.uuid4().hex
        where = f"{self.path}/{name}/{segment}"
        order = self._bucketed(rows, key).repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
        order.write.parquet(f"{where}/rows")
        ids.select(key).distinct().coalesce(8).write.parquet(f"{where}/ids")
        return {"id": segment, "key": key, "bytes": self._bytes(where)}

    def replace(self, name: str, rows: DataFrame, documents: DataFrame | None = None, key: str = "doc_id") -> None:
        """Rows of these documents (a table of doc_id; those of the rows, if not given) in place of all they had: one that now has none loses them.
        Writes these rows and ids and nothing else. Rows without an id are kept beside each other."""
        with self.transaction():
            self._open.setdefault(name, []).append(self._written(name, rows, (rows if documents is None else documents).where(F.col(key).isNotNull()), key))

    def put(self, name: str, rows: DataFrame, part: str) -> None:
        """Rows in place of those with the same values of the column `part`: written again, they are there once."""
        self.replace(name, rows, key=part)

    def compact(self, name: str, last: int | None = None) -> None:
        """The newest `last` segments, or all, as one. Rows that are replaced go; ids that older segments may hold stay decided."""
        before, tables = self.version()
        segments = tables.get(name, [])
        last = len(segments) if last is None else min(last, len(segments))
        if last < 2:
            return
        old, new = segments[: len(segments) - last], segments[len(segments) - last :]
        key = new[0]["key"]
        ids = self._ids(name, new)
        made = self._written(name, self._merged(name, new).drop("bucket"), ids if old else ids.limit(0), key)
        self._commit(before, tables | {name: [*old, made]})

    def _tidy(self, name: str) -> None:
        """Merges the newest segments while the next older one is not over twice as large as they are together; TIER of them at least."""
        sizes = [s["bytes"] for s in self._segments(name)]
        last, total = 1, sizes[-1]
        while last < len(sizes) and sizes[-1 - last] <= 2 * total:
            total += sizes[-1 - last]
            last += 1
        if last >= TIER:
            with contextlib.suppress(Conflict):  # another writer goes first; the next one tidies up
                self.compact(name, last)

    def vacuum(self) -> None:
        """Removes segments that the newest version does not name. No reader of an older one, and no writer, may be at work."""
        _, tables = self.version()
        for name in {*TABLES, *tables}:
            fs, p = self._fs(f"{self.path}/{name}")
            if fs.exists(p):
                live = {s["id"] for s in tables.get(name, [])}
                for x in fs.listStatus(p):
                    if x.getPath().getName() not in live:
                        fs.delete(x.getPath(), True)

    # --- reading ---

    def _ids(self, name: str, segments: list[dict]) -> DataFrame:
        """The ids that segments decide, each with the newest segment's number `_newest`."""
        key, out = segments[0]["key"], None
        for i, s in enumerate(segments):
            one = self.spark.read.parquet(f"{self.path}/{name}/{s['id']}/ids").withColumn("_newest", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out.groupBy(key).agg(F.max("_newest").alias("_newest"))

    def _merged(self, name: str, segments: list[dict], where=None) -> DataFrame:
        """The rows that count of some consecutive segments. where: a filter that goes to the files."""
        rows, key = None, segments[0]["key"]
        some = lambda df: df if where is None else df.where(where)
        for i, s in enumerate(segments):
            one = some(self.spark.read.parquet(f"{self.path}/{name}/{s['id']}/rows")).withColumn("_segment", F.lit(i))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        if len(segments) > 1:
            # what the oldest segment decides is in no older one, so only the newer ones' ids are joined
            newer = self._ids(name, segments[1:]).withColumn("_newest", F.col("_newest") + 1)
            rows = rows.join(newer, key, "left").where("_newest is null or _segment >= _newest").drop("_newest")
        return rows.drop("_segment")

    def read(self, name: str, schema: StructType | str | None = None) -> DataFrame:
        """A table without its bucket column; with a schema, a table that is not there yet is empty."""
        segments = self._segments(name)
        if not segments:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self._merged(name, segments).drop("bucket")

    def document(self, name: str, doc_id) -> DataFrame:
        """One document's rows, out of its bucket."""
        segments = self._segments(name)
        if not segments:
            raise KeyError(name)
        bucket = F.pmod(F.xxhash64(F.lit(str(doc_id))), F.lit(self.buckets)).cast("int")  # folded into a number, which the files' statistics are asked for
        return self._merged(name, segments, (F.col("bucket") == bucket) & (F.col("doc_id") == doc_id)).drop("bucket")

    def ids(self, name: str = "pages") -> DataFrame:
        return self.read(name).select("doc_id").distinct().orderBy("doc_id")

    def bootstrap(self, database: str = "paperloom") -> None:
        """A database with a view of each table that is there, for SQL, as of the newest version."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name, segments in self.version()[1].items():
            columns = [c for c in self.read(name).columns]
            parts = []
            for i, s in enumerate(segments):
                there = self.spark.read.parquet(f"{self.path}/{name}/{s['id']}/rows").columns
                listed = ", ".join(f"`{c}`" if c in there else f"NULL AS `{c}`" for c in columns)
                newer = " ".join(f"LEFT ANTI JOIN parquet.`{self.path}/{name}/{x['id']}/ids` USING ({s['key']})" for x in segments[i + 1 :])
                parts.append(f"SELECT {listed} FROM parquet.`{self.path}/{name}/{s['id']}/rows` {newer}")
            self.spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {' UNION ALL '.join(parts)}")


def write_csv(rows: DataFrame, path: str, files: int | None = 1) -> None:
    """CSV files with a header each: one, which a single task writes, or `files`, or with None as many as rows has partitions."""
    cut = rows if files is None else rows.coalesce(1) if files == 1 else rows.repartition(files)
    cut.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_jdbc(rows: DataFrame, url: str, name: str, properties: dict | None = None) -> None:
    """Rows appended to a table of a database, batch by batch, from all tasks at once. For one row a key see upsert.py."""
    rows.write.mode("append").jdbc(url, name, properties=properties or {})


def read_pdf_pages(spark: SparkSession, paths: str, extract) -> DataFrame:
    """path, page_no, text, width, height of PDF files. extract(bytes) gives (text, width, height) of each page; no PDF
    library is part of this package."""
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(paths).where(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    schema = StructType([StructField("path", StringType()), StructField("page_no", IntegerType()), StructField("text", StringType()), StructField("width", DoubleType()), StructField("height", DoubleType())])

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, i, t, w, h) for p, c in zip(b["path"], b["content"]) for i, (t, w, h) in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "width", "height"])

    return files.select("path", "content").mapInPandas(run, schema)


def list_documents(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_chunks; 0 where a document has none; and the name, if documents have one."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    both = documents.select("doc_id", *(["name"] if "name" in documents.columns else [])).join(count(pages, "n_pages"), "doc_id", "left").join(count(chunks, "n_chunks"), "doc_id", "left")
    return both.select("doc_id", *(["name"] if "name" in documents.columns else []), F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))

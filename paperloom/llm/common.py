"""What several operators share: stored stages, words of a text, and hashes of words in numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import threading
import time
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the word rule `[^\x20\x09-\x0D]+`, as a Java character class.
SPACE = r"[ \t-\r]"

#: Most bytes of an Arrow batch, and text bytes of a part of what is dealt by hash.
BATCH, PART = 4 << 20, 16 << 20

_made: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, where driver and executors are one
    process (a local master, as in tests), a temporary folder that is then set as the checkpoint folder."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        given = tempfile.mkdtemp(prefix="paperloom-")
        sc.setCheckpointDir(given)
        _made.append((spark, given))
    return given.rstrip("/")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows between Spark and Python, for the jobs run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of the lineage that survives
    the loss of any executor. The tables go when the driver's interpreter ends."""
    spark = settled(df.sparkSession)
    path = f"{shared_dir(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    with batches_of(spark, 2000):
        df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_made):
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is already gone
            return


def settled(spark: SparkSession) -> SparkSession:
    """The session with two settings. A union that passes its inputs' partitioning on can fail where adaptive execution
    gives them unequal numbers of partitions ("Can't zip RDDs with unequal numbers of partitions"), so it does not. Arrow
    batches are bounded by bytes, so that long texts come few at a time."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the column text, by a scan of it alone."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession, nbytes: int = 0) -> int:
    """Parts that nbytes are dealt over: about PART each, and one for each partition of a shuffle at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // PART))


def grouped(df: DataFrame, n: int, *keys: str):
    """df.groupBy(keys), in n partitions where the session's are fewer."""
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(n, *keys)
    return df.groupBy(*keys)


def released(value=None):
    """value, after what a Python worker has freed went back to the system: numpy's small arrays and Arrow's pool keep it
    otherwise, while the worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)
    return value


def releasing(run):
    """run, a function of Arrow batches, that gives memory back at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def releasing_cogroup(run):
    """run, a function of a key and two Arrow tables, after which memory is given back."""

    def whole(key, left, right):
        try:
            return run(key, left, right)
        finally:
            released()

    return whole


# --- words ---------------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def is_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte separates words."""
    return _IS_SPACE[data]


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; of a null, nothing."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def encoded_column(column) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; of a null, nothing."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def worker_value(key, make, idle_s: float = 2.0):
    """make(), once for each Python worker: tasks that follow at once find it again. A worker that waits longer lets it
    go, so that it takes no memory from later stages."""
    held = sys.modules.setdefault("_worker_values", types.ModuleType("_worker_values")).__dict__

    def drop():
        idle, tick = 0.0, idle_s / 8
        while idle < idle_s:
            time.sleep(tick)
            idle = 0.0 if sys.getrefcount(held[key]) > 2 else idle + tick  # more than the table's and the call's own
        del held[key]
        gc.collect()
        released()  # a worker that waits ends no task, which would do it

    if key in held:
        return held[key]
    value = held[key] = make()
    threading.Thread(target=drop, daemon=True).start()
    return value


def chunks(lengths, most: int = 4 << 20):
    """Slices of consecutive texts of about `most` bytes; a longer text is one alone."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n + 1
    if first < len(lengths):
        yield slice(first, len(lengths))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (SplitMix64's)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts: byte places in one buffer, and words[first[i]:first[i + 1]] of text i."""

    def __init__(self, raw: list[bytes], lower: bool = False):
        joined = b"\n".join(raw) + b"\n" + bytes(8)
        if lower:
            joined = joined.lower()
        self.data = joined
        self.buf = np.frombuffer(joined, np.uint8)[:-8]
        gap = _IS_SPACE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        at = np.cumsum([0] + [len(x) + 1 for x in raw])
        self.first = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        h = mix(left.astype(np.uint64))
        live = np.arange(len(at))
        while len(live):
            lane = lanes[at] & _MASKS[np.minimum(left, 8)]
            h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) + lane)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes, in order-dependent combination."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size, out, k = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64), np.uint64(1)
    for i in range(n):
        out += h[i : i + size] * k
        k = np.uint64((int(k) * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019 | 1) & (2**64 - 1))
    return mix(out)


def bounded_bloom(ids: DataFrame, column: str, bits_each: int = 12, most_bits: int = 1 << 29):
    """A Bloom filter of a column of longs, as bytes. Its size follows the count of ids up to `most_bits`
    (64 MB): beyond, it lets more strangers through, which the join after it removes; it loses none."""
    n = max(1, ids.count())
    bits = min(most_bits, 1 << max(16, (n * bits_each - 1).bit_length()))

    def build(batches):
        packed, step = np.zeros(bits // 8, np.uint8), 1 << 16
        for b in batches:
            h = mix(b.column(0).to_numpy().view(np.uint64))
            for k in range(3):
                at = mix(h + np.uint64(k)) & np.uint64(bits - 1)
                np.bitwise_or.at(packed, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(packed), step):
            if packed[i : i + step].any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int64()), "bits": pa.array([packed[i : i + step].tobytes()], pa.binary())})

    def merge(key, t):
        out = np.frombuffer(t.column("bits")[0].as_py(), np.uint8).copy()
        for x in t.column("bits").to_pylist()[1:]:
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    got = ids.select(F.col(column).cast("long")).coalesce(16).mapInArrow(build, "slice long, bits binary").groupBy("slice").applyInArrow(merge, "slice long, bits binary").collect()
    whole = bytearray(bits // 8)
    for r in got:
        whole[r["slice"] : r["slice"] + len(r["bits"])] = r["bits"]
    return bytes(whole)


def bloom_has(bloom: bytes, ids: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bloom, np.uint8)
    h, size = mix(ids.astype(np.int64).view(np.uint64)), np.uint64(len(bloom) * 8 - 1)
    out = np.ones(len(ids), bool)
    for k in range(3):
        at = mix(h + np.uint64(k)) & size
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out

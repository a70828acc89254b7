"""Approximate search by inner product: inverted lists around centroids, of which a query probes the nearest.

Centroids come from a bounded sample; every vector is then dealt to the list of its nearest centroid. Lists are kept as
blocks of rows, so that a large list is many rows of its table, and one product of matrices scores a block for all queries that
probe it. What is probed is scored exactly. How many lists to probe follows from the recall that is asked for,
measured on some of the vectors against exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import blocks
from .search import DECIMALS, dense, ranked


#: Numbers of an array of rows by centroids, or of repeated rows, at most.
CELLS = 1 << 20


@dataclass(frozen=True)
class Fit:
    """sample: vectors that centroids are learnt from, at most, by a hash of their keys. lists: how many, or the square root of the number of
    vectors, so that a query compares as many centroids as a list has rows; each has `least` vectors of the sample at least."""

    sample: int = 1 << 16
    lists: int | None = None
    least: int = 16
    rounds: int = 12
    seed: int = 5


@dataclass(frozen=True)
class Ivf:
    """centroids (one a row, of bounded size) and the table of lists: list, keys, dim, cells (see blocks.packed)."""

    key: str
    centroids: np.ndarray
    lists: DataFrame

    def save(self, path: str) -> None:
        """Blocks sorted by list, so that statistics of files and row groups tell which to read; the centroids as one row."""
        spark = self.lists.sparkSession
        self.lists.write.mode("overwrite").parquet(f"{path}/lists")
        one = [(self.key, *map(int, self.centroids.shape), self.centroids.astype(np.float64).tobytes())]
        spark.createDataFrame(one, "key string, n int, dim int, cells binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ivf:
        r = spark.read.parquet(f"{path}/centroids").first()
        return Ivf(r["key"], np.frombuffer(r["cells"]).reshape(r["n"], r["dim"]), spark.read.parquet(f"{path}/lists"))


def _nearness(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Larger for nearer centroids, row by row."""
    return x @ centroids.T - (centroids**2).sum(1) / 2


def _nearest(x: np.ndarray, centroids: np.ndarray, probes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids of each row, and the nearness of the first, some rows at a time, so that memory does not grow with rows times centroids."""
    probes, step = min(probes, len(centroids)), max(1, CELLS // max(1, len(centroids)))
    which, best = np.empty((len(x), probes), np.int64), np.empty(len(x))
    for i in range(0, len(x), step):
        near = _nearness(x[i : i + step], centroids)
        which[i : i + step] = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
        best[i : i + step] = near.max(axis=1)
    return which, best


def kmeans(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; a centroid that loses all vectors takes one of those that are farthest from theirs."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own, best = _nearest(x, centroids)
        own = own[:, 0]
        size = np.bincount(own, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = sums / np.maximum(size, 1)[:, None]
        if len(empty := np.flatnonzero(size == 0)):
            centroids[empty] = x[np.argsort(best)[: len(empty)]]
    return centroids


def _good(vectors: DataFrame, key: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where(F.col(key).isNotNull() & F.forall("embedding", finite) & (F.size("embedding") > 0)).select(key, F.col("embedding").cast("array<double>").alias("embedding"))


def centroids_of(vectors: DataFrame, key: str, fit: Fit = Fit()) -> np.ndarray:
    """Centroids of vectors (key, embedding) of one length. The sample is learnt from in one task, which its bound allows."""
    good = _good(vectors, key)
    n = good.count()
    if n == 0:
        return np.zeros((0, 0))
    lists = min(fit.lists or max(1, round(n**0.5)), max(1, min(n, fit.sample) // fit.least))
    some = good.orderBy(F.xxhash64(key), key).limit(fit.sample).withColumn("one", F.lit(1))

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by(key)
        c = kmeans(t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(t), -1), lists, fit.rounds, fit.seed)
        return pa.table({"cells": pa.array([c.tobytes()], pa.binary())})

    return np.frombuffer(some.groupBy("one").applyInArrow(learn, "cells binary").first()["cells"]).reshape(lists, -1)


def build(vectors: DataFrame, key: str, fit: Fit = Fit()) -> Ivf:
    """The index of all vectors (key, embedding), which have one length. Null keys and vectors that are null, empty or hold a null or no number
    take no part."""
    centroids = centroids_of(vectors, key, fit)
    kind = StructType([StructField("list", IntegerType()), StructField("keys", ArrayType(vectors.schema[key].dataType)), StructField("dim", IntegerType()), StructField("cells", BinaryType())])
    if not len(centroids):
        return Ivf(key, centroids, vectors.sparkSession.createDataFrame([], kind))
    return Ivf(key, centroids, blocks.packed_by(_dealt(vectors, key, centroids, 1), "list", key, ["keys", "dim", "cells"]))


def _dealt(vectors: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """list, key, embedding: each vector with each of the lists of its nearest centroids."""
    good, dim = _good(vectors, key), centroids.shape[1]
    kind = StructType([StructField("list", IntegerType()), *good.schema])

    def run(batches):
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            if (sizes != dim).any():
                raise ValueError(f"a vector has not the index's length, {dim}")
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            # a row is repeated for each list that it probes, so few rows are repeated at a time
            step = max(1, CELLS // max(1, dim * probes))
            for i in range(0, len(x), step):
                near, _ = _nearest(x[i : i + step], centroids, probes)
                at = pa.array(i + np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["list", key, "embedding"])

    return good.mapInArrow(run, kind)


def search(index: Ivf, queries: DataFrame, top: int = 30, probes: int = 8, decimals: int = DECIMALS) -> DataFrame:
    """query_id, key, rank, score: the best of what each query (query_id, embedding) probes, ties by key."""
    asked = blocks.packed_by(_dealt(queries, "query_id", index.centroids, max(1, probes)), "list", "query_id", ["asked", "asked_dim", "asked_cells"])
    scores = blocks.best_of(index.lists.join(asked, "list"), index.key, top, decimals)
    return ranked(scores.withColumn("score", F.round("score", decimals)), index.key, top)


def probed_share(index: Ivf, queries: DataFrame, probes: int) -> DataFrame:
    """One row, share: of the vectors, what a query reads on average."""
    sizes = index.lists.groupBy("list").agg(F.sum(F.size("keys")).alias("n"))
    read = _dealt(queries, "query_id", index.centroids, max(1, probes)).join(sizes, "list", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return read.agg(F.avg("n").alias("n")).join(sizes.agg(F.sum("n").alias("all")), F.lit(True)).select((F.col("n") / F.col("all")).alias("share"))


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row, recall: of the keys in the exact ranking, how many were found for the same query."""
    hit = exact.join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def probes_for(index: Ivf, vectors: DataFrame, goal: float = 0.9, top: int = 10, asked: int = 64) -> int:
    """The least number of lists, doubling from one, whose recall at `top` reaches the goal for `asked` of the vectors, chosen by a hash of their
    keys, against exact search over all."""
    some = _good(vectors, index.key).orderBy(F.xxhash64(index.key, F.lit(1)), index.key).limit(asked).withColumnRenamed(index.key, "query_id")
    exact, probes = dense(vectors, some, index.key, top).cache(), 1
    try:
        while probes < len(index.centroids) and (recall(search(index, some, top, probes), exact, index.key).first()["recall"] or 0) < goal:
            probes *= 2
    finally:
        exact.unpersist()
    return min(probes, max(1, len(index.centroids)))

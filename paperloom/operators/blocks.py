"""Exact inner products of all vectors with all queries, block by block.

Vectors and queries are packed into blocks of rows. Each block of vectors meets each block of queries once, as one product
of matrices, and keeps its best rows for each query; only these are ranked. The blocks of queries go to all tasks if
they are of checked size; else blocks meet blocks in a distributed product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

#: Rows of a block, and bytes of queries that go to all tasks at most.
ROWS, BROADCAST = 2048, 64 << 20


def whole(v: Column) -> Column:
    """Whether a vector is there and holds no null."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull())


def packed(vectors: DataFrame, key: str, keys: str, dim: str, cells: str) -> DataFrame:
    """Rows of arrays: keys, dim, cells (doubles, row by row) of vectors (key, embedding) of one length. Null keys and vectors
    that are null or hold a null take no part."""
    kind = StructType([StructField(keys, ArrayType(vectors.schema[key].dataType)), StructField(dim, IntegerType()), StructField(cells, BinaryType())])
    good = vectors.where(F.col(key).isNotNull() & whole(F.col("embedding")))

    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            sizes, flat = np.asarray(lists.value_lengths()), lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                for i in range(0, len(at), ROWS):
                    some = at[i : i + ROWS]
                    rows = flat[(ends[some] - n)[:, None] + np.arange(n)]
                    names = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(pa.array(some)))
                    yield pa.RecordBatch.from_arrays([names, pa.array([n], pa.int32()), pa.array([rows.astype(np.float64).tobytes()], pa.binary())], names=[keys, dim, cells])

    return good.select(key, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, kind)


def packed_by(vectors: DataFrame, by: str, key: str, names: list[str]) -> DataFrame:
    """Rows of arrays (by, *names) of at most ROWS vectors (by, key, embedding) with one value of `by`, names as in packed(); vectors have one length. Values of `by`
    are dealt by ranges, so a frequent one spreads."""
    rows, spark = ROWS, vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = vectors.select(by, key, "embedding").withColumn("_h", F.xxhash64(key)).repartitionByRange(n, by, "_h").sortWithinPartitions(by, key).drop("_h")
    kind = StructType([vectors.schema[by], StructField(names[0], ArrayType(vectors.schema[key].dataType)), StructField(names[1], IntegerType()), StructField(names[2], BinaryType())])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for i in range(0, len(t), rows):
                some = t.slice(i, rows)
                cells = some["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                keys = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some[key].combine_chunks())
                yield pa.RecordBatch.from_arrays([some[by].combine_chunks()[:1], keys, pa.array([len(cells) // len(some)], pa.int32()), pa.array([cells.astype(np.float64).tobytes()], pa.binary())], names=[by, *names])

        for b in batches:
            of = b.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and (held[0].column(0)[0].as_py() != of[i] or sum(map(len, held)) >= rows):
                    yield from out()
                held.append(b.slice(i, j - i))
        if held:
            yield from out()

    return near.mapInArrow(run, kind)


def best_products(vectors: DataFrame, queries: DataFrame, key: str, top: int, decimals: int, size: int | None = None) -> DataFrame:
    """query_id, key, score: for each block of vectors (key, embedding) the best rows of each query (query_id, embedding) by the
    inner product rounded to decimals, ties by key; the score is not rounded. Vectors of unlike lengths do not meet.
    size: bytes of the queries' vectors, counted here where they are not known."""
    left, right = packed(vectors, key, "keys", "dim", "cells"), packed(queries, "query_id", "asked", "asked_dim", "asked_cells")
    if size is None:
        size = queries.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    return best_of(left.crossJoin(F.broadcast(right) if size <= BROADCAST else right).where("dim = asked_dim"), key, top, decimals)


def best_of(pairs: DataFrame, key: str, top: int, decimals: int) -> DataFrame:
    """The same of pairs of blocks (keys, dim, cells, asked, asked_dim, asked_cells) of one length."""
    kind = StructType([StructField("query_id", pairs.schema["asked"].dataType.elementType), StructField(key, pairs.schema["keys"].dataType.elementType), StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                dim, keys, asked = row["dim"].as_py(), row["keys"].values, row["asked"].values
                order = np.argsort(np.array(keys.to_pylist()), kind="stable")  # by key, so that the first of equals is the least
                v, q = (np.frombuffer(row[c].as_buffer(), np.float64).reshape(-1, dim) for c in ("cells", "asked_cells"))
                exact = q @ v[order].T
                scores, take = np.round(exact, decimals), min(top, len(order))
                floor = np.partition(scores, len(order) - take, axis=1)[:, len(order) - take]
                which, place = [], []
                for k in range(len(q)):
                    at = np.flatnonzero(scores[k] >= floor[k])
                    at = at[np.argsort(-scores[k, at], kind="stable")[:take]]
                    which.append(np.full(len(at), k))
                    place.append(at)
                which, place = np.concatenate(which), np.concatenate(place)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(which)), keys.take(pa.array(order[place])), pa.array(exact[which, place])], names=["query_id", key, "score"])

    return pairs.mapInArrow(run, kind)

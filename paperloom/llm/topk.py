"""Exact top-k inner products in three phases with a uniform threshold.

The columns of the vectors are dealt to `NODES` nodes, each of which knows a part of every score. Rows
are packed into chunks; each chunk of candidates meets each chunk of queries once in either pass.

1. Each node lists its best part scores; the totals of what is listed are lower bounds, and the k-th
   best of them over all chunks is a query's safe cutoff.
2. The cutoff goes back with the queries. A node passes on an entry only if its part is at least
   cutoff / NODES: an entry that no node passes on has a total below the cutoff.
3. The remaining entries' scores are resolved exactly, and the best k are kept.

No step leaves out a candidate, so results are exact. The query chunks go to all tasks, at most `BROADCAST` bytes of
them at a time; candidates are dealt over tasks once for either pass, and what moves then is at most k rows for each
query and task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, stored, table

NODES = 4
CHUNK, QUERY_CHUNK = 2048, 512
#: Bytes of query chunks that go to all tasks at a time; part results and results that a task holds.
BROADCAST, LOWS, HELD = 32 << 20, 1 << 22, 1 << 18
PACKED = "dim int, n int, ids binary, cells binary"
LEAST = -(2**63)


def _narrow(cells: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all."""
    low, high = int(cells.min(initial=0)), int(cells.max(initial=0))
    return cells.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _packer(most: int):
    """Packs rows (vec_id, embedding) into chunks of vectors of one length. Drops ids, vectors and
    components that are null or not finite."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, cells = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for i in range(0, len(ids), most):
                part = ids[i : i + most]
                yield pa.RecordBatch.from_pylist([{"dim": dim, "n": len(part), "ids": part.tobytes(), "cells": _narrow(cells[i : i + most])}], pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())]))

        for b in batches:
            ids, lists = b.column(0), b.column(1)
            good = np.array([v.is_valid for v in lists], bool) & np.asarray(ids.is_valid())
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            ends = np.cumsum(lengths)
            key = np.asarray(ids.fill_null(0))
            for dim in np.unique(lengths[good]):
                at = np.flatnonzero(good & (lengths == dim))
                cells = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                fine = np.isfinite(cells).all(1)
                cells = np.floor(256 * cells[fine])
                if len(cells) and dim and np.abs(cells).max() * 1.0 > 2.0**62:
                    raise ValueError("a component times 256 does not fit a 64-bit integer")
                held.setdefault(int(dim), []).append((key[at][fine], cells.astype(np.int64)))
                if sum(len(x[0]) for x in held[int(dim)]) >= 4 * most:
                    yield from out(int(dim))
        for dim in list(held):
            yield from out(dim)

    return run


def _part_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Exact part scores of each node: in floats or doubles where they hold every sum exactly, else in Python's integers."""
    dim = q.shape[1]
    most = NODES * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1)
    kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else object
    cuts = [dim * j // NODES for j in range(NODES + 1)]
    return [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T if b > a else np.zeros((len(q), len(c)), kind) for a, b in zip(cuts, cuts[1:])]


def _cells(row_ids, row_cells, dim):
    ids = np.frombuffer(row_ids, np.int64)
    width = len(row_cells) // (len(ids) * dim) if dim else 1
    return ids, np.frombuffer(row_cells, f"i{width}").reshape(len(ids), dim).astype(np.int64)


def _pairs(batches):
    """Pairs of chunks of queries and candidates, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            r = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
            yield r, *_cells(r["q_ids"], r["q_cells"], r["dim"]), *_cells(r["ids"], r["cells"], r["dim"])


def _listing(s: np.ndarray, take: int) -> np.ndarray:
    """Places, in the array laid flat, of what a node lists: each row's `take` best at least."""
    size, n = s.shape[1], s.shape[1] // 32
    if s.dtype != object and n >= take:
        # every 32nd entry is a group; the take-th best of the groups' best is no more than the take-th best entry
        best = s[:, : 32 * n].reshape(len(s), 32, n).max(1)
        at = np.flatnonzero(s >= np.partition(best, n - take, axis=1)[:, n - take, None])
        if len(at) <= 8 * take * len(s):
            return at
    order = np.argpartition(s, size - take, axis=1) if s.dtype != object else np.argsort(s, axis=1)
    return (np.arange(len(s))[:, None] * size + order[:, size - take :]).ravel()


def _total(scores: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    return sum((s.ravel()[at] for s in scores[1:]), scores[0].ravel()[at])


def _listed(k: int, scores: list[np.ndarray], qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """For each query the k best totals of what the nodes' lists hold, LEAST where there are fewer."""
    at = np.unique(np.concatenate([_listing(s, min(k + 1, len(ci))) for s in scores]))
    at = at[qi[at // len(ci)] != ci[at % len(ci)]]
    rows, total = at // len(ci), _total(scores, at).astype(np.int64)
    order = np.lexsort((~total, rows))
    rows, total = rows[order], total[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    low = np.full((len(qi), k), LEAST, np.int64)
    low[rows[place < k], place[place < k]] = total[place < k]
    return low


def _first(k: int):
    """Phase 1: for each chunk of queries, the k best totals of each query that this task's candidates list, LEAST where there are fewer."""

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def out():
            for chunk, low in held.items():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "low": pa.array([low.tobytes()], pa.binary())})
            held.clear()

        for r, qi, q, ci, c in _pairs(batches):
            low = held.get(r["chunk"])
            if low is None:
                if sum(x.size for x in held.values()) >= LOWS:
                    yield from out()
                low = np.full((len(qi), k), LEAST, np.int64)
            both = np.concatenate([low, _listed(k, _part_scores(q, c), qi, ci)], 1)
            held[r["chunk"]] = np.ascontiguousarray(np.sort(both, axis=1)[:, ::-1][:, :k])
        yield from out()

    return run


def _cutoffs(k: int):
    """The k-th best of what tasks found for each query of a chunk: with fewer than k it is LEAST, so that all pass."""

    def run(key, t):
        low = None
        for x in t.column("low").to_pylist():
            one = np.frombuffer(x, np.int64).reshape(-1, k)
            low = one if low is None else np.sort(np.concatenate([low, one], 1), axis=1)[:, -k:]
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "cutoffs": pa.array([low.min(axis=1).tobytes()], pa.binary())})

    return run


def _best(k: int, ids: np.ndarray, found: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties by vec_id."""
    order = np.lexsort((found, ~score, ids))
    ids, found, score = ids[order], found[order], score[order]
    fine = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return ids[fine], found[fine], score[fine]


def _second(k: int):
    """Phases 2 and 3: entries that a node passes on, resolved; the best k of this task's for each query."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def best():
            return _best(k, *(np.concatenate(x) for x in zip(*held)))

        def out(rows):
            yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(pa.array, rows))))

        n = 0
        for r, qi, q, ci, c in _pairs(batches):
            scores = _part_scores(q, c)
            cutoffs = np.frombuffer(r["cutoffs"], np.int64)
            floor, part = cutoffs.astype(scores[0].dtype)[:, None], reduce(np.maximum, scores)
            # a quarter of a float is exact
            at = np.flatnonzero(part >= floor / NODES if part.dtype != object else (NODES * part >= floor).astype(bool))
            rows, cols = at // len(ci), at % len(ci)
            total = _total(scores, at)
            fine = (total >= floor[rows, 0]).astype(bool) & (qi[rows] != ci[cols])
            rows, cols, total = rows[fine], cols[fine], total[fine].astype(np.int64)
            if not len(rows):
                continue
            held.append(_best(k, qi[rows], ci[cols], total))
            n += len(held[-1][0])
            if n >= HELD:
                held, n = [best()], 0
                if len(held[0][0]) >= HELD // 2:
                    yield from out(held.pop())
        if held:
            yield from out(best())

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors (vec_id, embedding) for each row where is_query.

    Scores are inner products of floor(256 * x); ties go to the smaller vec_id. Null ids and vectors that
    are null or hold a null or a non-finite component take no part; vectors of unlike lengths do not
    meet. Rows with the query's own id are left out; a query id that occurs more than once asks with its
    smallest vector, and equal candidate rows each take a rank. Other columns are ignored; no queries give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # dealt by hash, so that a table of one file is scored by many tasks
    candidates = stored(rows.mapInArrow(_packer(CHUNK), PACKED), "candidates").select("dim", "ids", "cells")
    candidates = candidates.repartition(parts(spark), F.xxhash64("ids"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = rows.where(is_query & usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked.mapInArrow(_packer(QUERY_CHUNK), PACKED), "asked").select("dim", F.xxhash64("ids").alias("chunk"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    size = asked.agg(F.sum(F.octet_length("q_ids") + F.octet_length("q_cells"))).first()[0] or 0
    groups = max(1, -(-size // BROADCAST))
    found = None
    for g in range(groups):
        some = asked.where(F.pmod("chunk", F.lit(groups)) == g)
        low = candidates.join(F.broadcast(some), "dim").select("dim", "chunk", "q_ids", "q_cells", "ids", "cells").mapInArrow(_first(k), "chunk long, low binary")
        told = stored(some.join(low.groupBy("chunk").applyInArrow(_cutoffs(k), "chunk long, cutoffs binary"), "chunk"), "cutoffs")
        one = candidates.join(F.broadcast(told), "dim").select("dim", "q_ids", "q_cells", "cutoffs", "ids", "cells").mapInArrow(_second(k), "query_id long, vec_id long, score long")
        if groups > 1:  # one group's chunks are with the driver at a time
            one = stored(one, "found")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 5"""

QUERIES = {"op8_exact_top_k": op8_exact_top_k}
ORACLES = {"op8_exact_top_k": ORACLE_SQL}

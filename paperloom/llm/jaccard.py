"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

Sets of n-grams are rows of a sparse matrix whose product with itself counts overlaps. Three bounds that
follow from the sizes of two sets keep the product sparse:

* sizes: two sets can only link if the smaller has `threshold` times the larger's size;
* columns: in one order of all n-grams, linked sets share one of their first size - ceil(threshold * size) + 1;
  only these columns are multiplied, a block of columns at a time, the rarest first (by a sketch of fixed
  size that counts n-grams over all documents);
* rest: the overlap counted so far plus the most that can follow it must reach the bound for the pair.

Pairs that survive are counted in full. Equal sets are one row. Before the product, each set is compared
with the most typical set of each of a few min-hash buckets: sets found linked to the same one already
share a component, and the product leaves out pairs within such a cluster. Links within a cluster are counted by
dense products of blocks of its sets, which give each set's number and no pairs, so that no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, batches_of, bloom_has, bounded_bloom, chunks, encoded_column, mix, releasing, stored, table
from .components import components

#: Cells of the sketch of n-gram counts, in how many slices it is summed, and min-hash buckets of a set.
CELLS, SLICES, BUCKETS = 1 << 22, 64, 3
#: Sets in a column from which it is crowded: there, sets of at most CARRIED first columns bring them all along, and a pair is
#: made only if the first columns that it shares, and all that can follow, reach its bound.
CROWDED, CARRIED = 32, 512
#: Sets of a cluster that a block holds on average, and n-grams that a product of two blocks takes at a time.
BLOCK, WIDE = 256, 4096


def _sets(raw: list[bytes], n: int):
    """For each text its distinct n-gram hashes, sorted; of a shorter text, its whole sequence of words as one."""
    words = Words(raw, lower=True)
    h = words.hashes()
    grams = np.zeros(0, np.uint64)
    if len(h) >= n:
        grams = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = h[a : a + 1]
            for i in range(a + 1, b):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            yield mix(x + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _rows(batches, n: int):
    """(doc_id, set) of each row, in lists of some megabytes of text."""
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            some = b.slice(i, 1000)
            ids, raw = some.column(0).to_pylist(), encoded_column(some.column(1))
            for part in chunks([len(x) for x in raw], 2 << 20):
                yield list(zip(ids[part], _sets(raw[part], n)))


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """A sketch of fixed size (one byte a cell): for each cell, on a scale of logarithms, in how many documents' sets an
    n-gram of it occurs."""
    step = CELLS // SLICES

    def count(batches):
        cells = np.zeros(CELLS, np.uint16)
        for some in _rows(batches, n):
            at, times = np.unique((np.concatenate([s for _, s in some]) % np.uint64(CELLS)).astype(np.int64), return_counts=True)
            cells[at] = np.minimum(cells[at] + times, 65535)
        for i in range(SLICES):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "cells": pa.array([cells[i * step : (i + 1) * step].astype(np.uint32).tobytes()], pa.binary())})

    def add(key, t):
        total = np.zeros(step, np.uint32)
        for x in t["cells"]:
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    def scaled(batches):
        for b in batches:
            small = [np.round(np.log2(1.0 + np.frombuffer(x, np.uint32)) * 7.9).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary())], names=["slice", "cells"])

    kind = "slice int, cells binary"
    each = docs.select("doc_id", "text").mapInArrow(releasing(count), kind)
    # in two steps, so that no task holds the slices of all others
    some = each.withColumn("g", F.pmod(F.xxhash64("cells"), F.lit(32)).cast("int")).groupBy("slice", "g").applyInArrow(add, kind)
    out = np.zeros(CELLS, np.uint8)
    with batches_of(docs.sparkSession, 2000):
        got = some.groupBy("slice").applyInArrow(add, kind).mapInArrow(scaled, kind).collect()
    for r in got:
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["cells"], np.uint8)
    return out


def _described(n: int, percent: int, counts: bytes):
    """For each set: size, fingerprint, how typical it is, min-hash keys and its first columns."""

    def run(batches):
        cells = np.frombuffer(counts, np.uint8)
        for some in _rows(batches, n):
            out = {k: [] for k in ("doc_id", "size", "f1", "f2", "typical")}
            keys, firsts = [], []
            for doc, s in some:
                m = len(s)
                out["doc_id"].append(doc)
                out["size"].append(m)
                with np.errstate(over="ignore"):
                    out["f1"].append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if m else 0)
                    out["f2"].append(int(mix(s * np.uint64(0xD6E8FEB86659FD93)).sum().view(np.int64)) if m else 0)
                seen = cells[(s % np.uint64(CELLS)).astype(np.int64)]
                out["typical"].append(float(seen.mean()) if m else 0.0)
                mins = [int(mix(s ^ np.uint64(0x9E37 * (j + 1))).min().view(np.int64)) for j in range(BUCKETS)] if m else []
                keys.append(mins)
                order = np.lexsort((s, seen))[: m - -(-percent * m // 100) + 1] if m else np.zeros(0, np.int64)
                firsts.append(s[order].view(np.int64))
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            ends = np.cumsum([0] + [len(x) for x in firsts])
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["f1"], pa.int64()), pa.array(out["f2"], pa.int64()), pa.array(out["typical"], pa.float64()), pa.array(keys, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "size", "f1", "f2", "typical", "keys", "first"])

    return releasing(run)


def _sets_of(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """d, s: the sets of documents in ids (d), and of some strangers."""
    bloom = bounded_bloom(ids, "d")

    def wanted(batches):
        for b in batches:
            keep = bloom_has(bloom, b.column(0).fill_null(0).to_numpy(zero_copy_only=False)) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            if keep.any():
                asked = pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in b.columns], names=b.schema.names)
            for rows in _rows([asked], n) if keep.any() else ():
                ends = np.cumsum([0] + [len(s) for _, s in rows])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([s for _, s in rows]).view(np.int64)))], names=["d", "s"])

    return docs.select("doc_id", "text").mapInArrow(releasing(wanted), "d long, s array<long>")


def _overlapping(pairs: DataFrame, docs: DataFrame, n: int, percent: int, counts_name: str) -> DataFrame:
    """Of pairs (a, b) of documents, those that link, by counting their overlap in full."""
    pairs = stored(pairs, counts_name)
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), docs, n)
    both = pairs.join(sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + percent) * shared >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def _block_links(percent: int):
    """For each pair of blocks of a cluster, whose rows (cluster, lo, hi, at, doc_id, copies, s) come together: how many rows of the
    other block each set links to, its copies included."""

    def links(t: pa.Table):
        doc, copies, at = (t[c].to_numpy() for c in ("doc_id", "copies", "at"))
        lists = t["s"].combine_chunks()
        size, values = np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(doc)), size)
        _, gram, times = np.unique(values, return_inverse=True, return_counts=True)
        several = times > 1
        row, gram = row[several[gram]], (np.cumsum(several) - 1)[gram[several[gram]]]
        by = np.argsort(gram, kind="stable")
        row, gram = row[by], gram[by]
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        shared = np.zeros((len(left), len(right)), np.float32)
        for first in range(0, int(several.sum()), WIDE):
            i, j = np.searchsorted(gram, (first, first + WIDE))
            holds = np.zeros((len(doc), WIDE), np.float32)
            holds[row[i:j], gram[i:j] - first] = 1
            shared += holds[left] @ holds[right].T
        linked = (100 + percent) * shared.astype(np.int64) >= percent * (size[left][:, None] + size[right])
        linked &= doc[left][:, None] != doc[right]
        found, many = doc[left], linked @ copies[right]
        if lo != hi:
            found, many = np.concatenate((found, doc[right])), np.concatenate((many, linked.T @ copies[left]))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(many, pa.int64())], names=["rep", "degree"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and keys[i] != key:
                    yield links(pa.Table.from_batches(held))
                    held = []
                key = keys[i]
                held.append(b.slice(i, j - i))
        if held:
            yield links(pa.Table.from_batches(held))

    return releasing(run)


def _within(clusters: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """rep, degree: how many rows each set of clusters (doc_id, cluster, copies) links to by links to other sets of its cluster.

    A cluster's sets are dealt over blocks, and each pair of blocks is counted by itself, so a large cluster spreads over tasks that hold
    two blocks each."""
    many = clusters.groupBy("cluster").agg(F.count("*").alias("c")).where("c > 1").select("cluster", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    members = stored(clusters.join(many, "cluster").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "members")
    sets = _sets_of(members.select(F.col("doc_id").alias("d")).distinct(), docs, n).withColumnRenamed("d", "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = members.join(sets, "doc_id").withColumn("other", other).select("cluster", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "doc_id", "copies", "s")
    near = met.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    return near.mapInArrow(_block_links(percent), "rep long, degree long").groupBy("rep").agg(F.sum("degree").alias("degree"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each row of docs (doc_id, text).

    A document's set: the distinct n-word shingles of its lower-cased (A-Z) words; with fewer words, all of them as
    one. Two link when 100 * intersection >= percent * union. component_id: the least doc_id reachable
    by links, itself included. n_links: how many other rows the document links to, copies and all others. A null or empty text
    has an empty set and no link. A null doc_id takes no part and has a null component. Rows that share a doc_id link to each other.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = gram_counts(rows, n).tobytes()
    described = stored(rows.mapInArrow(_described(n, percent, counts), "doc_id long, size long, f1 long, f2 long, typical double, keys array<long>, first array<long>"), "sets")

    # equal sets: the least document stands for all
    real = described.where("size > 0 and doc_id is not null")
    equal = real.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = real.join(equal, ["f1", "f2", "size"]).where("doc_id = rep").dropDuplicates(["doc_id", "f1", "f2"])
    reps = stored(reps.select("doc_id", "size", "typical", "keys", "first"), "representatives")

    # clusters: sets that link to the most typical set of a bucket
    keyed = reps.select("doc_id", "size", "typical", F.posexplode("keys").alias("j", "key"))
    heads = keyed.groupBy("j", "key").agg(F.max(F.struct("typical", F.negative("doc_id").alias("d"), "size")).alias("h"), F.count("*").alias("c")).where("c > 1")
    apt = keyed.join(heads, ["j", "key"]).select("doc_id", "size", F.col("h.typical").alias("typical"), (-F.col("h.d")).alias("head"), F.col("h.size").alias("head_size"))
    apt = apt.where((F.col("doc_id") != F.col("head")) & (100 * F.least("size", "head_size") >= percent * F.greatest("size", "head_size")))
    apt = apt.select(F.col("doc_id").alias("a"), F.col("head").alias("b"), "typical").distinct()
    apt = stored(apt, "heads")
    starred = stored(_overlapping(apt.select("a", "b"), rows, n, percent, "head-pairs"), "stars")
    best = starred.join(apt, ["a", "b"]).groupBy("a").agg(F.max(F.struct("typical", F.negative("b").alias("d"))).alias("h")).select(F.col("a").alias("doc_id"), (-F.col("h.d")).alias("cluster"))
    # a head that has a head itself keeps its own cluster; either way a cluster is linked through its head
    own = starred.select(F.col("b").alias("doc_id")).distinct().withColumn("is_head", F.lit(True))
    placed = reps.join(best, "doc_id", "left").join(own, "doc_id", "left")
    cluster = F.when(F.col("is_head"), F.col("doc_id")).otherwise(F.coalesce("cluster", "doc_id"))

    # the product over the first columns, between clusters
    cells = placed.select("doc_id", "size", cluster.alias("cluster"), F.posexplode("first").alias("pos", "gram"))
    column = Window.partitionBy("gram")
    cells = cells.withColumn("low", F.min("cluster").over(column)).withColumn("high", F.max("cluster").over(column)).where("low <> high").drop("low", "high")
    # a set that is alone of its cluster in a column meets the column's others; of clusters with several sets in it, those of
    # the smaller meet those of the larger; what the bounds exclude is left out where it meets
    counts_ = {"mates": F.count("*").over(Window.partitionBy("gram", "cluster")), "all": F.count("*").over(column)}
    cells = stored(cells.withColumns(counts_), "cells")
    firsts = reps.where(F.size("first") <= CARRIED).select("doc_id", F.col("first").alias("row"))
    crowded = cells.where(F.col("all") > CROWDED).join(firsts, "doc_id", "left")
    plain = cells.where(F.col("all") <= CROWDED).withColumn("row", F.lit(None).cast("array<long>"))
    cells = plain.unionByName(crowded)
    named = lambda df, x: df.select("gram", F.col("cluster").alias(f"c{x}"), F.col("mates").alias(f"m{x}"), F.col("doc_id").alias(x), F.col("size").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("row").alias(f"r{x}"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    # what may be shared before this n-gram, it, and after it
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least("pa", "pb") + 1 + rest >= need)
    # the columns past the first ones of both, at most: one less than a set's share that any partner must have
    past = F.ceil(percent * F.greatest("na", "nb") / F.lit(100)) - 1
    fits &= F.col("ra").isNull() | F.col("rb").isNull() | (F.size(F.array_intersect("ra", "rb")) + past >= need)
    right = named(cells, "b")
    alone = named(cells.where("mates = 1"), "a").join(right, "gram").where((F.col("ca") != F.col("cb")) & ((F.col("mb") > 1) | (F.col("a") < F.col("b"))) & fits)
    groups = cells.where("mates > 1").select("gram", "cluster", "mates").distinct()
    meet = groups.select("gram", F.col("cluster").alias("ca"), F.col("mates").alias("ma")).join(groups.select("gram", F.col("cluster").alias("cb"), F.col("mates").alias("mb")), "gram")
    meet = meet.where("ma < mb or ma = mb and ca < cb").select("gram", "ca", "cb")
    several = meet.join(named(cells, "a"), ["gram", "ca"]).join(right, ["gram", "cb"]).where(fits)
    near = alone.select("a", "b", "na", "nb", "pa", "pb").unionByName(several.select("a", "b", "na", "nb", "pa", "pb"))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("both"), rest.alias("rest_after"))
    summed = near.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("both").alias("both"), F.min("rest_after").alias("rest"))
    pairs = summed.where(F.col("c") + F.col("rest") >= F.ceil(percent * F.col("both") / F.lit(100 + percent))).select("a", "b")
    linked = stored(_overlapping(pairs, rows, n, percent, "pairs"), "linked")
    links = stored(starred.unionByName(linked).distinct(), "all-links")

    found = components(links)
    # links of clusters with each other, and those within them; each counts the copies of the set at its other end
    copies = equal.groupBy("rep").agg(F.sum("copies").alias("copies"))
    between = linked.select(F.col("a").alias("d"), F.col("b").alias("rep")).unionByName(linked.select(F.col("b").alias("d"), F.col("a").alias("rep")))
    between = between.join(copies, "rep").groupBy(F.col("d").alias("rep")).agg(F.sum("copies").alias("degree"))
    within = _within(placed.select("doc_id", cluster.alias("cluster")).join(copies.withColumnRenamed("rep", "doc_id"), "doc_id"), rows, n, percent)
    degree = between.unionByName(within).groupBy("rep").agg(F.sum("degree").alias("degree"))
    classes = equal.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    classes = classes.select("f1", "f2", "size", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("links"))
    # empty sets have no class: they stay out of the join, where all would be one key
    alone = F.col("doc_id").isNull() | (F.col("size") == 0)
    out = described.where(~alone).select("doc_id", "size", "f1", "f2").join(classes, ["f1", "f2", "size"])
    result = lambda df, component, links: df.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), links.cast("long").alias("n_links"))
    return result(out, F.col("component"), F.col("links")).unionByName(result(described.where(alone), F.col("doc_id"), F.lit(0)))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), 3, 90)


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}

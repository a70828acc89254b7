"""BM25 over an index that prunes: postings in blocks by term and region, read by the buckets of a query's terms, scored only where a
block can still matter.

Keys are dealt over regions by a hash, some REGION to each. A block is a term's postings in one region, with the largest count and the
least length that occur in it, so that what a block can add to a score is bounded whatever the mean length becomes. A query
first scores the regions with the highest bounds; the score at its last place there is a threshold, and only
regions whose bounds reach it are scored besides. The result is that of the plain ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .index import TOKENS, Index
from .search import BM25_DECIMALS, K1, B, query_terms, ranked

#: Keys of a region, folders that terms are dealt over, and distinct terms of queries that are collected to choose folders at most.
REGION, BUCKETS, MOST_TERMS = 1024, 64, 10_000
#: Regions that a task makes blocks of, on average.
NEAR = 8


@dataclass(frozen=True)
class Blocks:
    """blocks (bucket, term, region, n, max_tf, min_dl, keys, tfs, dls) and stats (n, avg_dl)."""

    kind: str
    key: str
    blocks: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """A folder for each bucket of terms, within it files sorted by term."""
        n = _parts(self.blocks.sparkSession, self.blocks.agg(F.max("region")).first()[0] or 0)
        self.blocks.repartitionByRange(max(n, BUCKETS), "bucket", "term", "region").sortWithinPartitions("bucket", "term", "region").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        self.stats.select("*", F.lit(self.kind).alias("kind"), F.lit(self.key).alias("key")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Blocks:
        stats = spark.read.parquet(f"{path}/stats")
        r = stats.first()
        return Blocks(r["kind"], r["key"], spark.read.parquet(f"{path}/blocks"), stats.select("n", "avg_dl"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(index: Index) -> Blocks:
    """Blocks of an index without scopes. A block has some REGION postings at most on average, however frequent its term is."""
    if index.scope:
        raise ValueError("an index with scopes has no blocks")
    regions = max(1, -(-index.lengths.count() // REGION))
    key = index.key
    region = F.pmod(F.xxhash64(key), F.lit(regions))
    # texts with one key are one text, as postings have them
    if index.texts is not None and index.texts.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        made = _of_texts(index, region, regions)
    else:
        each = index.postings.join(index.lengths, key).select("term", region.alias("region"), key, "tf", "dl")
        made = each.groupBy("term", "region").agg(F.array_sort(F.collect_list(F.struct(key, "tf", "dl"))).alias("p"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        made = made.select("term", "region", F.size("p").alias("n"), "max_tf", "min_dl", F.col(f"p.{key}").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    lists = made.select(_bucket(F.col("term")).alias("bucket"), "term", "region", "n", "max_tf", "min_dl", "keys", "tfs", "dls")
    return Blocks(index.kind, key, lists, index.stats)


def _parts(spark: SparkSession, regions: int) -> int:
    """Tasks that regions are dealt over: some NEAR regions to each, so that what a task holds does not grow with the texts."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-regions // NEAR))


def _of_texts(index: Index, region: Column, regions: int) -> DataFrame:
    """Blocks of whole texts, which go to their region's task; there a region's words are sorted once."""
    key, spark = index.key, index.texts.sparkSession
    texts = index.texts.where(F.col(key).isNotNull()).select(region.alias("region"), key, TOKENS[index.kind](F.coalesce("text", F.lit(""))).alias("words"))
    near = texts.repartition(_parts(spark, regions), "region").sortWithinPartitions("region", key)
    kind = StructType([StructField("term", StringType()), texts.schema["region"], StructField("n", IntegerType()), StructField("max_tf", LongType()), StructField("min_dl", IntegerType()), StructField("keys", ArrayType(texts.schema[key].dataType)), StructField("tfs", ArrayType(LongType())), StructField("dls", ArrayType(IntegerType()))])

    def blocks_of(t: pa.Table):
        keys, lists = t[key].combine_chunks(), t["words"].combine_chunks()
        dl = np.asarray(lists.value_lengths())
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cell, tf = np.unique(code * len(t) + np.repeat(np.arange(len(t)), dl), return_counts=True)
        term, row = cell // len(t), cell % len(t)
        edges = np.searchsorted(term, np.arange(len(flat.dictionary) + 1))
        ends, of = pa.array(edges, pa.int32()), lambda x: pa.ListArray.from_arrays(ends, x)
        least = np.minimum.reduceat(dl[row], edges[:-1])
        yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(np.full(len(edges) - 1, t["region"][0].as_py())), pa.array(np.diff(edges).astype(np.int32)), pa.array(np.maximum.reduceat(tf, edges[:-1]).astype(np.int64)), pa.array(least.astype(np.int32)), of(keys.take(pa.array(row))), of(pa.array(tf.astype(np.int64))), of(pa.array(dl[row].astype(np.int32)))], names=kind.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            r = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1), len(r)]
            for i, j in zip(cuts, cuts[1:]):
                if held and i < j and held[0].column(0)[0].as_py() != r[i]:
                    yield from blocks_of(pa.Table.from_batches(held))
                    held = []
                if i < j:
                    held.append(b.slice(i, j - i))
        if held:
            yield from blocks_of(pa.Table.from_batches(held))

    return near.mapInArrow(run, kind)


def _part(tf, dl, mean):
    """What a count adds to a score, but for its term's weight: more for larger counts and for shorter texts."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _read(index: Blocks, terms: DataFrame) -> DataFrame:
    """The blocks of the folders that the terms of the queries lie in. Where these are few, the folders are named to the scan, and
    with them the terms, which it compares with statistics of its row groups."""
    some = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(some) > MOST_TERMS:
        return index.blocks
    spark = terms.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in some], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    return index.blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(some))


def candidates(index: Blocks, queries: DataFrame, top: int, first: int = 2) -> tuple[DataFrame, DataFrame]:
    """blocks of the queries' terms with what they weigh (query_id, term, region, weight, mean, bound), and of these the ones to be scored.
    first: regions with the highest bounds, which set a query's threshold."""
    terms = query_terms(queries, index.kind)
    blocks = _read(index, terms)
    mean = F.when(F.col("avg_dl") > 0, F.col("avg_dl")).otherwise(1.0) if index.kind == "stemmed" else F.col("avg_dl") + 1e-5
    # counts and bounds are columns of their own, so that lists are read only where a block is scored
    heads = blocks.select("term", "region", F.col("n").alias("here"), "max_tf", "min_dl")
    df = heads.groupBy("term").agg(F.sum("here").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", idf.alias("weight"), mean.alias("mean"))
    found = weighed.join(heads, "term").withColumn("bound", F.col("weight") * _part(F.col("max_tf"), F.col("min_dl"), F.col("mean"))).select("query_id", "term", "region", "weight", "mean", "bound")
    region = found.groupBy("query_id", "region").agg(F.sum("bound").alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "region")
    leading = region.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).select("query_id", "region")
    scores = _scored(index, blocks, found.join(leading, ["query_id", "region"]), top)
    last = ranked(scores, index.key, top).groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("least"))
    # rounding may lift a score by half a unit of its last place
    slack = 10.0 ** -BM25_DECIMALS[index.kind]
    reach = region.join(last, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least"))).select("query_id", "region")
    return found, found.join(reach, ["query_id", "region"])


def _scored(index: Blocks, blocks: DataFrame, chosen: DataFrame, top: int) -> DataFrame:
    """query_id, key, score: of each region the best of each query that has blocks chosen in it. A region's blocks and what is asked of it meet in one
    task and are summed there, as a region holds all of its texts' postings; only its best go on."""
    key, decimals = index.key, BM25_DECIMALS[index.kind]
    lists = blocks.select("region", "term", "keys", "tfs", "dls")
    kind = StructType([chosen.schema["query_id"], StructField(key, blocks.schema["keys"].dataType.elementType), StructField("raw", DoubleType())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.combine_chunks(), held.combine_chunks()
        if not len(asked) or not len(held):
            return pa.table({f.name: pa.array([], f.type) for f in to_arrow_schema(kind)})
        flat = held["keys"].combine_chunks().flatten().dictionary_encode()
        keys, size = flat.dictionary, len(flat.dictionary)
        order = np.argsort(np.array(keys.to_pylist()), kind="stable")
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        doc = place[flat.indices.to_numpy(zero_copy_only=False)]
        tf, dl = (held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("tfs", "dls"))
        sizes = np.asarray(held["keys"].combine_chunks().value_lengths())
        stop = np.cumsum(sizes)
        at = {t: i for i, t in enumerate(held["term"].to_pylist())}
        ids = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        of = ids.indices.to_numpy(zero_copy_only=False)
        term = np.array([at.get(t, -1) for t in asked["term"].to_pylist()])
        weight, mean = asked["weight"].to_numpy(), asked["mean"].to_numpy()
        which, found, raw = [], [], []
        by = np.argsort(of, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
            scores = np.zeros(size)
            for r in rows:
                i = term[r]
                if i >= 0:
                    some = slice(stop[i] - sizes[i], stop[i])
                    scores[doc[some]] += weight[r] * _part(tf[some], dl[some], mean[r])
            shown, take = np.floor(scores * 10**decimals + 0.5), min(top, size)
            floor = np.partition(shown, size - take)[size - take]
            good = np.flatnonzero((shown >= floor) & (scores > 0))
            good = good[np.argsort(-shown[good], kind="stable")[:take]]
            which.append(np.full(len(good), of[rows[0]]))
            found.append(order[good])
            raw.append(scores[good])
        return pa.table([ids.dictionary.take(pa.array(np.concatenate(which))), keys.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(raw))], names=kind.names)

    summed = chosen.select("region", "query_id", "term", "weight", "mean").groupBy("region").cogroup(lists.groupBy("region")).applyInArrow(run, kind)
    return summed.select("query_id", key, F.round("raw", decimals).alias("score"))


def bm25(index: Blocks, queries: DataFrame, top: int = 30) -> DataFrame:
    """query_id, key, rank, score for queries (query_id, query): what search.bm25 gives."""
    blocks = _read(index, query_terms(queries, index.kind))
    _, chosen = candidates(index, queries, top)
    return ranked(_scored(index, blocks, chosen, top), index.key, top)


def work(index: Blocks, queries: DataFrame, top: int = 30) -> DataFrame:
    """One row: postings of the index, postings of the queries' terms, once for each query, and those of the blocks that are scored."""
    found, chosen = candidates(index, queries, top)
    heads = _read(index, query_terms(queries, index.kind)).select("term", "region", "n")
    count = lambda df, name: df.join(heads, ["term", "region"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    return index.blocks.agg(F.sum("n").alias("all_postings")).join(count(found, "asked"), F.lit(True)).join(count(chosen, "scored"), F.lit(True))

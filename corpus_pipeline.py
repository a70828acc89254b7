"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that its predecessor kept and, but for the last, returns the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import stored
from paperloom.llm.jaccard import jaccard_join
from paperloom.llm.packing import best_fit_packing, default_tokenizer
from paperloom.llm.pii import pseudonymise
from paperloom.llm.quality import quality_rules
from paperloom.llm.suffixes import without_repeats

#: Keys that go to all tasks at most, two longs each.
FEW = 1 << 17
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose keys (the columns of gone) are not in gone, which holds each once. Few go to all tasks, by a count
    of them; for more the texts are shuffled to them."""
    few = gone.count() <= FEW
    return docs.join(F.broadcast(gone) if few else gone, gone.columns, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own text, lang and source, whatever its doc_id, which may be null or
    shared. Equal rows stay or go together; a null text goes; an empty table stays one."""
    # what a verdict depends on, as 128 bits: rows that agree in it have one verdict
    row = F.struct(*[F.xxhash64(F.lit(i), F.struct(F.coalesce("text", F.lit("")), "lang", "source"), F.col("lang").isNull()).alias(f"h{i}") for i in (1, 2)])
    gone = quality_rules(docs.withColumn("doc_id", row)).where("not kept").select(F.col("doc_id.h1").alias("_h1"), F.col("doc_id.h2").alias("_h2")).distinct()
    return _without(docs.withColumns({"_h1": row["h1"], "_h2": row["h2"]}), stored(gone, "rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by 80 % of their five-word shingles, the one with the least doc_id; a null comes last.

    Rows are told apart by doc_id and text, so different texts may share an id; rows equal in both are one. Empty and null
    texts are linked with nothing, but rows of them that share an id are equal. An empty table stays one."""
    keyed = docs.withColumn("_row", F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 1))
    ids = stored(keyed.groupBy("_row", "doc_id").agg(F.count("*").alias("n")), "rows")
    group = jaccard_join(keyed.select(F.col("_row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
    kept = ids.join(group, "_row").groupBy("component_id").agg(least["_row"].alias("_row")).select("_row")
    judged = stored(ids.select("_row", "n").join(kept.withColumn("kept", F.lit(True)), "_row", "left"), "judged")
    # rows that are there more than once are few, and treated apart
    again = judged.where("kept and n > 1").select("_row")
    out = _without(keyed, judged.where("kept is null or n > 1").select("_row"))
    if again.count():
        one = Window.partitionBy("_row").orderBy("lang", "source")
        out = out.unionByName(keyed.join(again, "_row", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"))
    return out.select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 400 bytes that occur more than once. All rows stay, each judged by itself; null
    texts become empty."""
    return _documents(without_repeats(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what they repeat of others or of themselves: stretches of bytes, each in a string of 200 bytes that
    occurs more than once, where a stretch has over 50 words or 400 bytes. All rows stay, each judged by itself; null texts
    become empty. A repeated passage of over 50 words is found from 200 bytes on, which fewer than 51 words mostly have."""
    return _documents(without_repeats(docs, 200, 51, 400))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data. All rows stay, equal ones equal; null texts stay null."""
    return _documents(pseudonymise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096: rows of pieces, those of repeated rows as often as these occur."""
    return best_fit_packing(docs, default_tokenizer())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passages), ("pii", private), ("best-fit packing", packing)]

#: Shared strings and packing are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other, each stored and read again. Documents may be empty or null, share
    ids or repeat; what becomes of them each stage says. Other columns are left behind by the first stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

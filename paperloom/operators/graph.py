"""Entities of chunks and the graph of those that occur together.

Every step takes chunks (doc_id, chunk_no, text) of many documents at once; statistics are those of each document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ENTITY_PATTERNS, ENTITY_STOPWORDS, GRAPH_KEYWORDS, ORG_ENDING, PERSON_START, TECH_ENDING
from ..functions.text import caps, stable_id


def entity_type(raw: Column) -> Column:
    """PERSON, ORG, TECH, CONCEPT or TERM, by the first rule that fits."""
    camel, capitals = ENTITY_PATTERNS[1].replace(r"\b", ""), ENTITY_PATTERNS[2].replace(r"\b", "")
    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    return (
        F.when(raw.rlike(f"(?i){PERSON_START}"), "PERSON")
        .when(raw.rlike(ORG_ENDING), "ORG")
        .when(raw.rlike(f"(?i){TECH_ENDING}") | raw.rlike(f"^{capitals}$") | raw.rlike(f"^{camel}$"), "TECH")
        .when((F.size(words) > 1) & F.forall(words, lambda w: w.rlike("^[A-Z]")), "CONCEPT")
        .otherwise("TERM")
    )


def mentions(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, seq, raw, key: every hit of every pattern; seq orders a chunk's hits by pattern, then place."""
    hits = F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in ENTITY_PATTERNS])
    rows = chunks.select("doc_id", "chunk_no", F.posexplode(hits).alias("p", "found")).select("doc_id", "chunk_no", "p", F.posexplode("found").alias("i", "raw"))
    rows = rows.select("doc_id", "chunk_no", F.struct("p", "i").alias("seq"), F.trim("raw").alias("raw"))
    key = F.trim(F.regexp_replace(F.lower("raw"), r"\s+", " "))
    return rows.where((F.length("raw") >= 3) & ~F.lower("raw").isin(ENTITY_STOPWORDS)).withColumn("key", key).where(F.length("key") >= 3)


def entities(chunks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, key, text, etype, freq, df, score of every entity: the first form with the most capitals, the type of the
    first form, hits, chunks, and hits a chunk times ln((n + 1) / (df + 1)) + 1 over the document's n chunks."""
    at = F.struct("chunk_no", "seq")
    # the first mention has the least place; of equal capitals too
    place = lambda: F.struct((-F.col("caps")).alias("c"), at.alias("at"))
    m = (mentions(chunks) if found is None else found).withColumn("caps", caps(F.col("raw")))
    each = m.groupBy("doc_id", "key").agg(F.min_by("raw", place()).alias("text"), F.min_by("raw", at).alias("first"), F.count("*").alias("freq"), F.countDistinct("chunk_no").alias("df"))
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    score = F.col("freq") / F.col("n") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return each.join(n, "doc_id").select("doc_id", "key", "text", entity_type(F.col("first")).alias("etype"), "freq", "df", F.round(score, 9).alias("score"))


def top_entities(found: DataFrame, top: int = 80) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def nodes(top: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Nodes of the top entities; with what entity_pages gave, their pages."""
    if pages is not None:
        top = top.join(pages, ["doc_id", "key"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))
    return top.select("doc_id", stable_id(F.col("key")).alias("node_id"), "key", "text", "etype", "freq", "rank", *(["pages"] if pages is not None else []))


def entity_pages(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, key, pages: the pages of the chunks that mention an entity, sorted."""
    near = mentions(chunks).select("doc_id", "chunk_no", "key").distinct().join(spans.select("doc_id", "chunk_no", "page_no"), ["doc_id", "chunk_no"])
    return near.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def cooccurrences(chunks: DataFrame, top: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, source_key, target_key, n, first_chunk: pairs of top entities by the chunks that have both. A chunk has at most
    `top` entities, so its pairs are bounded; they are made of its sorted keys in its row, without a join. found: mentions, if they are known."""
    seen = (mentions(chunks) if found is None else found).select("doc_id", "chunk_no", "key").distinct().join(top.select("doc_id", "key"), ["doc_id", "key"], "left_semi")
    keys = seen.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    first = keys.select("doc_id", "chunk_no", "keys", F.posexplode("keys").alias("i", "source_key"))
    pairs = first.select("doc_id", "chunk_no", "source_key", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("target_key"))
    return pairs.groupBy("doc_id", "source_key", "target_key").agg(F.count("*").alias("n"), F.min("chunk_no").alias("first_chunk"))


def edges(pairs: DataFrame, most: int = 150, least: float = 0.04) -> DataFrame:
    """doc_id, source, target, weight: counts over the document's largest, the first `most` and none under `least`."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy(F.desc("n"), "first_chunk", "source_key", "target_key")
    weight = F.round(F.col("n") / F.max("n").over(doc), 3)
    rows = pairs.withColumns({"weight": weight, "place": F.row_number().over(order)}).where((F.col("place") <= most) & (F.col("weight") >= least))
    return rows.select("doc_id", stable_id(F.col("source_key")).alias("source"), stable_id(F.col("target_key")).alias("target"), "weight")


def keyword_mentions(chunks: DataFrame, trimmed: bool = False, keywords: Sequence[str] = GRAPH_KEYWORDS) -> DataFrame:
    """Hits of keywords, the fixed ones by default. trimmed: words between white space, without signs around them."""
    if trimmed:
        words = F.transform(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    else:
        words = F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Za-z0-9.\-]+\b"), F.lit(0))
    return chunks.select("doc_id", "chunk_no", F.explode(F.filter(words, lambda w: w.isin(list(keywords)))).alias("key"))


def keyword_nodes(chunks: DataFrame, trimmed: bool = False, keywords: Sequence[str] = GRAPH_KEYWORDS) -> DataFrame:
    return keyword_mentions(chunks, trimmed, keywords).groupBy("key").agg(F.count("*").alias("freq"))


def keyword_edges(chunks: DataFrame, trimmed: bool = False, keywords: Sequence[str] = GRAPH_KEYWORDS) -> DataFrame:
    seen = keyword_mentions(chunks, trimmed, keywords).distinct()
    pairs = seen.withColumnRenamed("key", "source").join(seen.withColumnRenamed("key", "target"), ["doc_id", "chunk_no"]).where("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def filter_nodes(node_rows: DataFrame, types: list[str], text: str = "") -> DataFrame:
    return node_rows.where(F.col("etype").isin(types) & F.contains(F.lower("text"), F.lit(text.lower())))


def visible_edges(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    ends = node_rows.select("doc_id", "node_id")
    return edge_rows.join(ends.withColumnRenamed("node_id", "source"), ["doc_id", "source"], "left_semi").join(ends.withColumnRenamed("node_id", "target"), ["doc_id", "target"], "left_semi")


def neighbours(edge_rows: DataFrame) -> DataFrame:
    """doc_id, node_id, neighbour in both directions."""
    ends = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("neighbour"))
    return edge_rows.select("doc_id", F.explode(F.array(ends("source", "target"), ends("target", "source"))).alias("e")).select("doc_id", "e.*")


def type_counts(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("etype").agg(F.count("*").alias("n"))


def relative_size(node_rows: DataFrame) -> DataFrame:
    """nodes with `size`: 6, and up to 14 more for the share of the largest count; half of them where all counts are one."""
    top = F.max("freq").over(Window.partitionBy("doc_id"))
    return node_rows.withColumn("size", F.round(6 + F.when(top <= 1, 0.5).otherwise(F.col("freq") / top) * 14, 6))

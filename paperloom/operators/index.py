"""An inverted index as tables: postings(term, key, tf), lengths(key, dl), stats(n, avg_dl)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import space_tokens, tokenize, word_tokens

#: Tokenisers by the ranking they belong to.
TOKENS = {"stemmed": tokenize, "live": word_tokens, "space": space_tokens}


@dataclass(frozen=True)
class Index:
    """Tables of one tokeniser over texts with a key. With a scope column, statistics are those of each scope."""

    kind: str
    key: str
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    scope: str | None = None
    #: (key, text, and the scope), where the index is one of texts: rankings of few queries read these once and make no postings of other words.
    texts: DataFrame | None = None


def build(texts: DataFrame, key: str, kind: str = "live", scope: str | None = None) -> Index:
    """Index of texts (key, text, and the scope). Texts without tokens count in the statistics and match nothing."""
    tokens = TOKENS[kind](F.coalesce("text", F.lit("")))
    scopes = [scope] if scope else []
    # one row for each text with its term counts: lengths need no second pass over tokens
    each = texts.select(key, *scopes, tokens.alias("tokens"))
    lengths = each.select(key, *scopes, F.size("tokens").alias("dl"))
    postings = each.select(key, *scopes, F.explode("tokens").alias("term")).groupBy(key, *scopes, "term").agg(F.count("*").alias("tf"))
    stats = lengths.groupBy(*scopes).agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    return Index(kind, key, postings, lengths, stats, scope, texts.select(key, "text", *scopes))


def of_tables(postings: DataFrame, lengths: DataFrame, key: str, kind: str = "live") -> Index:
    """The index of stored postings (term, key, tf) and lengths (key, dl), with the statistics of the rows that are in them."""
    return Index(kind, key, postings, lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")))


def document_frequency(index: Index) -> DataFrame:
    scopes = [index.scope] if index.scope else []
    # by their counts, so that the postings are read as a ranking reads them, and made once for both
    return index.postings.groupBy("term", *scopes).agg(F.count_if(F.col("tf") > 0).alias("df"))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old with all rows of new's keys replaced by new's: rows that a shorter new version lacks go too."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def with_embeddings(chunks: DataFrame) -> DataFrame:
    """chunks, which fails where an embedding is missing."""
    return chunks.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("a chunk has no embedding"))))

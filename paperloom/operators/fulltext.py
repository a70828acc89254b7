"""Full-text match and rank by positions: how many of a query's terms a text holds, how often and how close together.

The index is a table of positions(term, key, positions), sorted arrays of word numbers; stop words are not in it but are
counted. A cover is a stretch of a text that holds all terms looked for and no shorter stretch that does. Covers come from
windows over a text's matches, by one sweep: a match that starts a cover is alive until its term occurs next; the cover
ends where all matches before it are dead and every term has been seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import STOPWORDS
from ..functions.text import stem
from .search import few, query_terms, ranked

#: What a cover is worth whose words are all matches, and the decimals of scores.
WEIGHT, DECIMALS = 0.1, 6

MATCHES = ("any", "most", "all")


def positions(texts: DataFrame, key: str) -> DataFrame:
    """term, key, positions of texts (key, text): stemmed words that are no stop words, with their numbers from 1 among all words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    each = texts.where(F.col(key).isNotNull()).select(key, F.posexplode(words).alias("i", "w")).where(~F.col("w").isin(STOPWORDS))
    return each.groupBy(stem(F.col("w")).alias("term"), key).agg(F.array_sort(F.collect_list(F.col("i") + 1)).alias("positions"))


def postings(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Rows of an index with terms of queries, those of a text in one task."""
    return index.join(query_terms(queries, "stemmed").select("term").distinct(), "term", "left_semi").repartition(key)


def matches(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key, term, positions of the texts that share a term with a query (query_id, query). Only postings of queries' terms are
    read on; a term that many queries have is joined with each of them, where the text's postings lie."""
    return _matched(postings(index, queries, key), queries, key)


def _matched(near: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    terms = query_terms(queries, "stemmed")
    return near.join(F.broadcast(terms) if few(terms) else terms, "term").select("query_id", key, "term", "positions")


def _leading(held: DataFrame, top: int) -> DataFrame:
    """query_id, least: the number of terms that a query's best texts (query_id, key, held) hold at least, so that there are `top`; 0 where
    there are fewer. From how many texts hold each number."""
    tally = held.groupBy("query_id", "held").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("held")))
    return tally.withColumn("upto", upto).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("upto") >= top, F.col("held"))), F.lit(0)).alias("least"))


def covers(found: DataFrame, key: str) -> DataFrame:
    """query_id, key, start, stop, n: the covers of the terms of each query that a text holds, with how many matches lie in each. found: see
    matches."""
    text, term = Window.partitionBy("query_id", key), Window.partitionBy("query_id", key, "term")
    at = F.struct(F.col("pos"), F.col("i"))
    rows = found.select("query_id", key, "term", F.explode("positions").alias("pos")).withColumn("i", F.row_number().over(text.orderBy("pos")))
    never = F.struct(F.lit(2**31 - 1).alias("pos"), F.lit(0).alias("i"))
    alive = rows.withColumn("next", F.coalesce(F.lead(at).over(term.orderBy("pos")), never)).withColumn("first", F.min(at).over(term))
    before = F.max("next").over(text.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    swept = alive.withColumn("stop", F.greatest(at, F.coalesce(before, at), F.max("first").over(text)))
    return swept.where(F.col("stop.pos") < F.col("next.pos")).select("query_id", key, F.col("pos").alias("start"), F.col("stop.pos").alias("stop"), (F.col("stop.i") - F.col("i") + 1).alias("n"))


def worth(start: Column, stop: Column, n: Column) -> Column:
    """A cover counts less for each word in it that is no match."""
    return WEIGHT / (1 + (stop - start + 1 - n))


def cover_density(index: DataFrame, queries: DataFrame, key: str, top: int = 30, match: str = "most") -> DataFrame:
    """query_id, key, rank, score of the best texts of an index of positions.

    match: 'any' takes each match for itself, as a database ranks words joined by OR: the score is WEIGHT for each. 'all' asks for
    texts with all of a query's terms, and adds up what their covers are worth. 'most' ranks by how many terms a text holds,
    then by the covers of these: the score is that number plus c / (1 + c), where c is their sum. Terms that a query repeats count once;
    queries without terms find nothing."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    near = postings(index, queries, key)
    found = _matched(near, queries, key)
    if match == "any":
        scores = found.groupBy("query_id", key).agg((WEIGHT * F.sum(F.size("positions"))).alias("score"))
    else:
        # by positions, so that the postings are read as covers read them, and made once for both
        held = found.groupBy("query_id", key).agg(F.count_if(F.size("positions") > 0).alias("held"))
        if match == "all":
            asked = query_terms(queries, "stemmed").groupBy("query_id").agg(F.count("*").alias("held"))
            best = held.join(F.broadcast(asked), ["query_id", "held"])
        else:
            # covers add less than a term does: texts with fewer terms than `top` others are behind these, whatever their covers
            best = held.join(F.broadcast(_leading(held, top)), "query_id").where("held >= least").drop("least")
        some = near.join(best.select(key), key, "left_semi")
        counted = _matched(some, queries, key).join(best, ["query_id", key])
        value = F.sum(worth(F.col("start"), F.col("stop"), F.col("n")))
        scores = covers(counted, key).groupBy("query_id", key).agg(value.alias("score"))
        if match == "most":
            scores = scores.join(best, ["query_id", key]).withColumn("score", F.col("held") + F.col("score") / (1 + F.col("score")))
    return ranked(scores.select("query_id", key, F.round("score", DECIMALS).alias("score")), key, top)

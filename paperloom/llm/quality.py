"""Quality rules with thresholds that each language and source sets for itself.

Every step is a DataFrame or SQL function. Counts are taken over whole texts. Instead of fixed
cutoffs, each measure is compared with a fence around the quartiles of its (lang, source) group. The
quartiles come from a mergeable quantile sketch: a histogram over an equal grid of integer buckets,
which merges by addition (so Spark pre-aggregates it before the shuffle, and a hot source costs no
more than another), keeps exact ranks, and errs by less than a bucket in value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """Reject beyond quartile +- reach * max(interquartile range, spread), in buckets."""

    measure: str
    reach: int
    spread: int
    below: bool = False


#: Measures are integers: shares in thousandths, the mean length of a word in hundredths.
FENCES = (
    Fence("symbol_share", 4, 5),
    Fence("dup_line_share", 4, 150),
    Fence("repeat_share", 4, 100),
    Fence("word_length", 8, 50, below=True),
)
#: The last bucket of the grid; larger values share it.
TOP = 100_000


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once although a lambda of use reads it for every element."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    def of_hashes(h):
        def of_sorted(s):
            same = lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
            at = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(at)))

        rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(F.sort_array(rows), of_sorted))

    def of_words(w):
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return _bind(F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), of_hashes)

    return _bind(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(of_words(w)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text. Null and empty texts count as 0 everywhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    both = docs.select("doc_id", "lang", "source", F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"), _bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep"))).alias("words"))
    return both.select("doc_id", "lang", "source", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.rep").cast("long").alias("n_repeat_words"))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, and for each fence low_<measure> and high_<measure>, from the texts that pass the base rules."""
    grid = F.explode(F.array(*[F.struct(F.lit(f.measure).alias("measure"), F.col(f.measure).alias("bucket")) for f in FENCES])).alias("x")
    sketch = measured.where(~F.col("base_failed")).select("lang", "source", grid).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source", "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    quartiles = ranked.groupBy("lang", "source").agg(*[F.min(F.when((F.col("measure") == f.measure) & (4 * F.col("upto") >= q * F.col("total")), F.col("bucket"))).alias(f"q{q}_{f.measure}") for f in FENCES for q in (1, 3)])
    out = []
    for f in FENCES:
        q1, q3 = F.col(f"q1_{f.measure}"), F.col(f"q3_{f.measure}")
        reach = f.reach * F.greatest(q3 - q1, F.lit(f.spread))
        out += [(q1 - reach if f.below else F.lit(-1).cast("long")).alias(f"low_{f.measure}"), (q3 + reach).alias(f"high_{f.measure}")]
    return quartiles.select("lang", "source", *out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source; other columns are ignored): the counts,
    base_failed and kept.

    Null texts count as empty and fail the base rules. A null lang or source is a group of its own.
    Equal rows get equal verdicts, ties at a fence are kept, and an empty table gives an empty one.
    """
    n, share = F.col("n_words"), lambda x, y: F.least(F.lit(TOP), F.floor(1000 * F.col(x) / F.greatest(F.lit(1), F.col(y)))).cast("long")
    counted = measures(docs).withColumns({
        "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": F.least(F.lit(TOP), F.floor(100 * F.col("word_chars") / F.greatest(F.lit(1), n))).cast("long"),
    })
    counted = stored(counted, "measures")
    limits = thresholds(counted)
    c, t = counted.alias("c"), limits.alias("t")
    fine = F.lit(True)
    for f in FENCES:
        fine &= F.col(f"c.{f.measure}").between(F.col(f"t.low_{f.measure}"), F.col(f"t.high_{f.measure}"))
    joined = c.join(t, F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select("c.doc_id", "c.lang", "c.source", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", "c.base_failed", (~F.col("c.base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quartile_sql(measure: str, q: int) -> str:
    return f"min(bucket) FILTER (measure = '{measure}' AND 4 * upto >= {q} * total) AS q{q}_{measure}"


_FINE_SQL = " AND ".join(
    f"{f.measure} <= q3_{f.measure} + {f.reach} * greatest(q3_{f.measure} - q1_{f.measure}, {f.spread})" + (f" AND {f.measure} >= q1_{f.measure} - {f.reach} * greatest(q3_{f.measure} - q1_{f.measure}, {f.spread})" if f.below else "")
    for f in FENCES
)

#: DuckDB SQL of the measures and verdicts over a relation `documents`.
MEASURED_SQL = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
tokens AS (SELECT r, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> ''), 1) AS i FROM texts),
triples AS (SELECT r, i, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM tokens WINDOW s AS (PARTITION BY r ORDER BY i)),
found AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM triples WHERE w3 IS NOT NULL) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM found) GROUP BY r),
totals AS (SELECT r, count(*) AS n FROM tokens GROUP BY r),
rows_ AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
counted AS (
  SELECT doc_id, lang, source, coalesce(totals.n, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN totals USING (r) LEFT JOIN repeats USING (r) JOIN rows_ USING (r)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    least({TOP}, 1000 * n_symbols // greatest(1, word_chars)) AS symbol_share, least({TOP}, 1000 * n_dup_lines // greatest(1, n_lines)) AS dup_line_share,
    least({TOP}, 1000 * n_repeat_words // greatest(1, n_words)) AS repeat_share, least({TOP}, 100 * word_chars // greatest(1, n_words)) AS word_length
  FROM counted),
long_ AS ({" UNION ALL ".join(f"SELECT lang, source, '{f.measure}' AS measure, {f.measure} AS bucket FROM measured WHERE NOT base_failed" for f in FENCES)}),
sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM long_ GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM sketch),
quartiles AS (SELECT lang, source, {", ".join(_quartile_sql(f.measure, q) for f in FENCES for q in (1, 3))} FROM ranked GROUP BY lang, source),
judged AS (SELECT m.*, NOT base_failed AND coalesce({_FINE_SQL}, false) AS kept FROM measured m LEFT JOIN quartiles q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source)
"""

ORACLE_SQL = f"""WITH {MEASURED_SQL}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM judged"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": ORACLE_SQL}

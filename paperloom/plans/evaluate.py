"""Quality of rankings and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(ranking: DataFrame, gold: DataFrame, queries: DataFrame, key: str = "doc_id", depth: int = 5) -> DataFrame:
    """One row: n, hit_1, hit_k and mrr. gold: (query_id, key), the rows that answer; a query's best rank counts."""
    best = ranking.where(F.col("rank") <= depth).join(gold.select("query_id", key).distinct(), ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    every = queries.select("query_id").join(best, "query_id", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6)
    return every.agg(F.count("*").alias("n"), share(F.col("rank") == 1).alias("hit_1"), share(F.col("rank").isNotNull()).alias("hit_k"), share(1 / F.col("rank")).alias("mrr"))


#: Rows of a group that are ranked one by one at most, and cells that a larger bracket is cut into.
MOST, CELLS = 100_000, 500


def at_places(rows: DataFrame, group: str, value: str, places: dict) -> DataFrame:
    """group, n and, for each name in places, the value at that place of the group's sorted values, counted from 0. places: name to a function of n,
    a Column. Null values take no part.

    By selection: a bracket that holds the value is counted, and cut by a sketch into cells, of which those around the place are the next
    bracket, until few rows are left in it; only these are ranked, equal ones once. No group is sorted or gathered."""
    good = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("_v"))
    first = good.groupBy(group).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), of(F.col("n")).cast("long").alias("_place")) for name, of in places.items()])).alias("w")
    brackets = first.select(group, "n", "_lo", "_hi", wanted).select(group, "n", "w.*", "_lo", "_hi", F.lit(None).cast("long").alias("_was")).cache()
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    keys = [group, "_name"]

    def met(b: DataFrame) -> DataFrame:
        return good.withColumnRenamed(group, "_g").join(b, F.col("_g").eqNullSafe(F.col(group))).drop("_g")

    while True:
        counted = met(brackets).groupBy(*keys, "n", "_place", "_lo", "_hi", "_was").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_in"), F.percentile_approx(F.when(inside, F.col("_v")), [i / CELLS for i in range(CELLS + 1)], 20 * CELLS).alias("_cells")).cache()
        # a bracket that is not halved holds a few values that are most of its rows, and equal rows are ranked once
        large = (F.col("_in") > MOST) & (F.col("_lo") < F.col("_hi")) & (F.col("_was").isNull() | (2 * F.col("_in") <= F.col("_was")))
        if counted.where(large).isEmpty():
            break
        # a cell's edge may be off by a twentieth of a cell, and the place lies in the cell before or after the one it should
        cell = F.floor((F.col("_place") - F.col("_below")) / F.col("_in") * CELLS).cast("int")
        edge = lambda by: F.get("_cells", F.least(F.greatest(cell + by, F.lit(0)), F.lit(CELLS)))
        brackets = counted.select(*keys, "n", "_place", F.when(large, F.when(cell < 2, F.col("_lo")).otherwise(edge(-2))).otherwise(F.col("_lo")).alias("_lo"), F.when(large, F.when(cell > CELLS - 3, F.col("_hi")).otherwise(edge(3))).otherwise(F.col("_hi")).alias("_hi"), F.when(large, F.col("_in")).otherwise(F.lit(0)).alias("_was")).cache()
    each = met(counted.drop("_cells")).where(inside).groupBy(*keys, "n", "_place", "_below", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("_upto", upto).where(F.col("_place") < F.col("_upto")).groupBy(group, "n", "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(group, "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def latencies(times: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, p50, p95: the values at places n // 2 and int(0.95 n) - 1 of the sorted times, counted from 0."""
    return at_places(times, group, value, {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.greatest(F.floor(n * 95 / 100) - 1, F.lit(0))})

"""As-of and interval joins by merging: both sides of a key in one order, so that work grows with rows and not with their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, marks: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """points (by, at, more) with `name`: the largest value of marks (by, at, name) whose `at` is not after the point's, in the order of
    `at`; null where there is none. Values of marks ascend with their places."""
    both = points.withColumn("_point", F.lit(True)).unionByName(marks.select(by, at, F.col(name).alias("_mark")).withColumn("_point", F.lit(False)), allowMissingColumns=True)
    so_far = Window.partitionBy(by).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_mark", ignorenulls=True).over(so_far)).where("_point").drop("_point", "_mark")


def overlapping(intervals: DataFrame, tiles: DataFrame, by: str, first: Column, last: Column, start: Column, number: str) -> DataFrame:
    """intervals joined with the tiles they may overlap. Tiles (by, number, more) follow each other: their numbers, from 1 in each key, ascend with `start`.
    An interval meets the tile that holds `first`, the one that holds `last`, and all between; both are found as of their places, so a key costs
    one sort of its rows, and the result is what is joined."""
    marks = tiles.select(by, start.alias("_at"), F.col(number).alias("_tile"))
    low = as_of(intervals.withColumn("_at", first), marks, by, "_at", "_tile").withColumnRenamed("_tile", "_from")
    both = as_of(low.withColumn("_at", last), marks, by, "_at", "_tile").drop("_at")
    met = both.withColumn("_from", F.coalesce("_from", F.lit(1))).where("_tile >= _from")
    return met.withColumn(number, F.explode(F.sequence("_from", "_tile"))).drop("_from", "_tile").join(tiles, [by, number])


def covered_until(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, stop: str) -> DataFrame:
    """points with `until`: the largest end of the intervals (by, start, stop) that begin at or before the point; null where there is none."""
    begun = intervals.select(by, F.col(start).alias(at), F.col(stop).alias("_stop")).withColumn("_point", F.lit(False))
    both = points.withColumn("_point", F.lit(True)).unionByName(begun, allowMissingColumns=True)
    so_far = Window.partitionBy(by).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("until", F.max("_stop").over(so_far)).where("_point").drop("_point", "_stop")

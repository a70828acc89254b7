"""Rectangles of words on pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words of a page with their places on it and in its text.
WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,start:int,end:int>>"


def overlapping(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["end"] > start) & (w["start"] < end))


def line_rects(words: Column, tolerance: float = 3.0) -> Column:
    """Words merged into one rectangle a line: a word joins the line before it if its top is within tolerance of the line's
    top so far. Rounded to two decimals."""
    rect = "array<struct<x0:double,y0:double,x1:double,y1:double>>"

    def step(lines, w):
        last = F.get(lines, F.size(lines) - 1)
        own = F.struct(w["x0"].cast("double").alias("x0"), w["y0"].cast("double").alias("y0"), w["x1"].cast("double").alias("x1"), w["y1"].cast("double").alias("y1"))
        grown = F.struct(F.least(last["x0"], own["x0"]).alias("x0"), F.least(last["y0"], own["y0"]).alias("y0"), F.greatest(last["x1"], own["x1"]).alias("x1"), F.greatest(last["y1"], own["y1"]).alias("y1"))
        joins = (F.size(lines) > 0) & (F.abs(own["y0"] - last["y0"]) <= tolerance)
        return F.when(joins, F.array_append(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), grown)).otherwise(F.array_append(lines, own))

    lines = F.aggregate(words, F.array().cast(rect), step)
    return F.transform(lines, lambda r: F.struct(*[F.round(r[c], 2).alias(c) for c in ("x0", "y0", "x1", "y1")]))


def scaled(rects: Column, page_width: Column, width: Column, margin: float = 1.0) -> Column:
    """Rectangles in a picture of the page of this width, with a margin around."""
    by = width / page_width
    return F.transform(rects, lambda r: F.struct((r["x0"] * by - margin).alias("left"), (r["y0"] * by - margin).alias("top"), ((r["x1"] - r["x0"]) * by + 2 * margin).alias("width"), ((r["y1"] - r["y0"]) * by + 2 * margin).alias("height")))


def clamp_page(page: Column, pages: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), pages)

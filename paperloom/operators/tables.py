"""Extracted tables: rows (doc_id, page_no, table_no, rows: array of arrays of strings), the header first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space

_CELL = lambda c: F.coalesce(normalize_space(c), F.lit(""))


def _header() -> Column:
    return F.transform(F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>")), _CELL)


def columns(tables: DataFrame) -> DataFrame:
    """doc_id, column, place: distinct header names in order of first appearance, place from 1."""
    cells = tables.select("doc_id", "page_no", "table_no", F.posexplode(_header()).alias("i", "column")).where("column <> ''")
    first = cells.groupBy("doc_id", "column").agg(F.min(F.struct("page_no", "table_no", "i")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).select("doc_id", "column", "place")


def project(tables: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id, page_no, table_no, row_no and one string column for each wanted header, in their order. A header's first
    place counts; what a row or a table lacks is empty; rows with nothing, and tables with no wanted header, go."""
    if not wanted:
        raise ValueError("no columns selected")
    body = tables.select("doc_id", "page_no", "table_no", _header().alias("h"), F.posexplode("rows").alias("row_no", "r")).where("row_no > 0")
    value = lambda name: F.when(F.array_contains("h", name), F.coalesce(_CELL(F.get("r", (F.array_position("h", name) - 1).cast("int"))), F.lit(""))).otherwise("")
    out = body.select("doc_id", "page_no", "table_no", "row_no", *[value(w).alias(w) for w in wanted])
    some = F.lit(False)
    for w in wanted:
        some |= F.col(f"`{w}`") != ""
    return out.where(some)


def sheet(tables: DataFrame) -> DataFrame:
    """doc_id, line_no, cells: all rows of all tables in order, nulls as empty strings, a blank row after each table."""
    rows = F.concat(F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))), F.array(F.array().cast("array<string>")))
    order = Window.partitionBy("doc_id").orderBy("page_no", "table_no", "i")
    return tables.select("doc_id", "page_no", "table_no", F.posexplode(rows).alias("i", "cells")).withColumn("line_no", F.row_number().over(order)).select("doc_id", "line_no", "cells")


def mask(tables: DataFrame, names: list[str]) -> DataFrame:
    """tables with the cells under some headers (whatever their case) nulled, the header row left."""
    hidden = F.transform(_header(), lambda h: F.lower(h).isin([n.lower() for n in names]))
    masked = F.transform("rows", lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda c, j: F.when(F.coalesce(F.get("hide", j), F.lit(False)), F.lit(None).cast("string")).otherwise(c))))
    return tables.withColumn("hide", hidden).withColumn("rows", masked).drop("hide")

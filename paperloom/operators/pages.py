"""Pages: rows (doc_id, page_no, text), page_no from 1."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import for_speech, strip


def pages_of_lines(docs: DataFrame, lines: int = 20) -> DataFrame:
    """Pages of consecutive lines of documents (doc_id, text). Joined by newlines, a document's pages are its text."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    first = F.sequence(F.lit(1), F.size("lines"), F.lit(lines))
    pages = F.transform(first, lambda i: F.array_join(F.slice("lines", i, F.lit(lines)), "\n"))
    return docs.select("doc_id", split.alias("lines")).select("doc_id", F.posexplode(pages).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page_no"), "text")


def page_starts(pages: DataFrame) -> DataFrame:
    """pages with `start`, where each begins in the text of all joined by newlines, and `length`."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("length", F.length("text")).withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).cast("int"))


def joined(pages: DataFrame) -> DataFrame:
    """doc_id, text: each document's pages joined by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def empty_pages(pages: DataFrame) -> DataFrame:
    """doc_id, warnings: one for each page without text, in order."""
    blank = pages.where(~F.col("text").rlike(r"(?U)\S"))
    said = F.transform(F.array_sort(F.collect_list("page_no")), lambda n: F.format_string("page %d: no extractable text", n))
    return blank.groupBy("doc_id").agg(said.alias("warnings"))


def scanned_documents(pages: DataFrame, least: int = 80) -> DataFrame:
    """Documents with so little text that their pages must be pictures."""
    return pages.groupBy("doc_id").agg(F.sum(F.length(strip(F.col("text")))).alias("chars")).where(F.col("chars") < least)


def parse_page_range(spec: str) -> list[tuple[int, int | None]]:
    """'1-3, 5' as [(1, 3), (5, 5)]; bad parts are an error."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)\s*(?:-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"no page range: {part!r}")
        out.append((int(m[1]), int(m[2] or m[1])))
    if not out:
        raise ValueError("no pages asked for")
    return out


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """The pages of a range of each document, numbered anew from 1; `source_page` is the old number."""
    wanted = F.lit(False)
    for first, last in parse_page_range(spec):
        wanted |= F.col("page_no").between(first, last)
    order = Window.partitionBy("doc_id").orderBy("source_page")
    return pages.where(wanted).withColumnRenamed("page_no", "source_page").withColumn("page_no", F.row_number().over(order))


def merge_documents(pages: DataFrame, files: DataFrame, stretch: int = 4096) -> DataFrame:
    """Pages of merged documents. files: (merged_id, position, doc_id), position a number; each result needs two files at least.

    A page's number is its place in its file, plus the pages of the files before it in its stretch of positions, plus those of the stretches before: a
    result of very many files is numbered by many tasks."""
    enough = files.groupBy("merged_id").agg(F.count("*").alias("n")).where("n >= 2").select("merged_id")
    chosen = files.join(enough, "merged_id", "left_semi").withColumn("_stretch", F.floor(F.col("position") / stretch))
    sizes = chosen.join(pages.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id").groupBy("merged_id", "_stretch", "position").agg(F.sum("_n").alias("_n"))
    before = lambda w, by: F.coalesce(F.sum("_n").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = sizes.groupBy("merged_id", "_stretch").agg(F.sum("_n").alias("_n")).withColumn("_far", before(Window.partitionBy("merged_id"), "_stretch")).drop("_n")
    offsets = sizes.withColumn("_near", before(Window.partitionBy("merged_id", "_stretch"), "position")).drop("_n").join(stretches, ["merged_id", "_stretch"])
    found = chosen.join(pages.withColumnRenamed("page_no", "source_page"), "doc_id").join(offsets, ["merged_id", "_stretch", "position"])
    place = F.row_number().over(Window.partitionBy("merged_id", "position").orderBy("source_page"))
    return found.withColumn("page_no", (F.col("_far") + F.col("_near") + place).cast("int")).select("merged_id", "page_no", "doc_id", "source_page", "text")


def speech_pages(pages: DataFrame) -> DataFrame:
    """Pages cleaned for speech; what is empty then goes, and the rest is numbered anew."""
    order = Window.partitionBy("doc_id").orderBy("source_page")
    clean = pages.select("doc_id", F.col("page_no").alias("source_page"), for_speech(F.col("text")).alias("text")).where("text <> ''")
    return clean.withColumn("page_no", F.row_number().over(order)).select("doc_id", "page_no", "text")


def with_recognised(pages: DataFrame, recognised: DataFrame, least: int = 80) -> DataFrame:
    """doc_id, text under '--- Page N ---' headings: a page's own text where there is enough, else the recognised one."""
    both = pages.alias("p").join(recognised.alias("r"), ["doc_id", "page_no"], "left")
    text = F.when(F.length(strip(F.col("p.text"))) > least, strip(F.col("p.text"))).otherwise(strip(F.coalesce("r.text", F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct("page_no", F.format_string("--- Page %d ---\n%s", "page_no", text).alias("t"))))
    return both.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))

"""Sentences, packed chunks with exact offsets, and the pages they lie on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ABBREVIATIONS, BOUNDARY
from ..functions.text import bind, count_tokens, normalize_space
from .embedding import with_next_cosine
from .intervals import covered_until, overlapping
from .pages import joined, page_starts

_JAVA_BOUNDARY = "(?U)" + BOUNDARY


@dataclass(frozen=True)
class ChunkSizes:
    target: int = 160
    most: int = 256
    least: int = 48
    overlap: int = 1
    percentile: float = 20.0
    window: int = 1

    def __post_init__(self):
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("sizes must be 0 < least <= target <= most")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no (from 0), start, end, tokens, sentence of documents (doc_id, text); offsets are code points.

    A text is cut where its boundary pattern matches; a cut after an abbreviation or an initial is taken back by
    joining the pieces around it (a running count of the true cuts numbers the sentences).
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.split(text, _JAVA_BOUNDARY, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(_JAVA_BOUNDARY), F.lit(0)).alias("gaps"))
    rows = cut.select("doc_id", F.posexplode(F.arrays_zip("pieces", "gaps")).alias("i", "x")).select("doc_id", "i", F.col("x.pieces").alias("piece"), F.col("x.gaps").alias("gap"))
    last = F.regexp_extract(F.substr("piece", F.greatest(F.length("piece") - 15, F.lit(1)), F.lit(16)), r"(?U)(\S+)\s*$", 1)
    false_cut = ~F.contains("gap", F.lit("\n\n")) & (F.lower(last).isin(ABBREVIATIONS) | last.rlike(r"^[A-Z]\.$"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("piece") + F.coalesce(F.length("gap"), F.lit(0))
    rows = rows.withColumns({"at": F.coalesce(F.sum(size).over(before), F.lit(0)), "group": F.coalesce(F.sum(F.when(false_cut, 0).otherwise(1)).over(before), F.lit(0))})
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "piece", "gap"))), lambda p: p)
    merged = rows.groupBy("doc_id", "group").agg(F.min("at").alias("at"), whole.alias("p"))
    # the gap after the last piece is no part of the sentence
    raw = F.array_join(F.transform("p", lambda p, i: F.concat(p["piece"], F.when(i < F.size("p") - 1, p["gap"]).otherwise(""))), "")
    merged = merged.select("doc_id", "group", "at", raw.alias("raw")).where(F.col("raw").rlike(r"(?U)\S"))
    start = F.col("at") + F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    out = merged.select("doc_id", start.cast("int").alias("start"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("sentence"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return out.select("doc_id", number.alias("sent_no"), "start", (F.col("start") + F.length("sentence")).alias("end"), count_tokens(F.col("sentence")).alias("tokens"), "sentence")


def hard_split(sents: DataFrame, most: int) -> DataFrame:
    """The same rows, with sentences of more than `most` words cut into windows of so many, numbered anew."""
    window = rf"(?U)\S++(?:\s++\S++){{0,{most - 1}}}+"
    whole = F.col("tokens") <= most
    parts = F.when(whole, F.array("sentence")).otherwise(F.regexp_extract_all("sentence", F.lit(window), F.lit(0)))
    gaps = F.when(whole, F.array(F.lit(""))).otherwise(F.split("sentence", window, -1))
    rows = sents.select("doc_id", "start", "tokens", F.posexplode(F.arrays_zip(parts.alias("s"), gaps.alias("g"))).alias("i", "x")).where(F.col("x.s").isNotNull())
    # where a window begins: what of its sentence is before it; a row holds its own words only
    upto = Window.partitionBy("doc_id", "start").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.col("start") + F.sum(F.length("x.g") + F.length("x.s")).over(upto)).cast("int")
    cut = rows.select("doc_id", (end - F.length("x.s")).alias("start"), end.alias("end"), F.least(F.lit(most), F.col("tokens") - F.col("i") * most).alias("tokens"), F.col("x.s").alias("sentence"))
    return cut.withColumn("sent_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).select("doc_id", "sent_no", "start", "end", "tokens", "sentence")


def with_breaks(sents: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """sents (doc_id, sent_no, sentence, more) with similarity and brk, both null where no break is looked for: after a document's last sentence, and
    in documents of under 4 sentences. Rows pass through, so that sentences are cut once for breaks and for what follows."""
    near = with_next_cosine(sents.withColumn("text", F.col("sentence")), sizes.window)
    doc = Window.partitionBy("doc_id")
    limit = F.percentile("similarity", F.lit(sizes.percentile / 100)).over(doc)
    found = near.withColumns({"limit": limit, "n": F.count("*").over(doc)})
    return found.withColumns({"similarity": F.when(F.col("n") >= 4, F.col("similarity")), "brk": F.when(F.col("n") >= 4, F.col("similarity") < F.col("limit"))}).drop("limit", "n")


def semantic_breaks(sents: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """doc_id, sent_no, similarity, is_break: a break follows a sentence whose surroundings are less like the next one's
    than the given percentile of the document's neighbours; documents of under 4 sentences have none."""
    found = with_breaks(sents.select("doc_id", "sent_no", "sentence"), sizes).where(F.col("similarity").isNotNull())
    return found.select("doc_id", "sent_no", "similarity", F.col("brk").alias("is_break"))


def _packed(rows: Column, sizes: ChunkSizes) -> Column:
    """Groups (first, last) of a document's sentences, by one fold.

    The open group is always a run of sentences, so its first sentence and how many of it are fresh are all the state;
    its tokens are a difference of running totals. rows: (i, tok, upto, kept_upto, kept_before, brk, last).
    """
    group = "array<struct<first:int,last:int>>"
    start = F.struct(F.lit(0).alias("first"), F.lit(0).cast("bigint").alias("base"), F.lit(0).alias("fresh"), F.array().cast(group).alias("groups"))
    state = lambda first, base, fresh, groups: F.struct(first.cast("int").alias("first"), base.cast("bigint").alias("base"), fresh.cast("int").alias("fresh"), groups.alias("groups"))
    emitted = lambda s, last: F.array_append(s["groups"], F.struct(s["first"].cast("int").alias("first"), last.cast("int").alias("last")))
    keep = sizes.overlap

    def step(s, x):
        before = x["upto"] - x["tok"]
        too_big = lambda s: (s["first"] < x["i"]) & (x["upto"] - s["base"] > sizes.most)
        clear = lambda s: state(x["i"], before, F.lit(0), s["groups"])

        def make_room(s):
            kept = (F.lit(keep > 0)) & (x["i"] - s["first"] > keep)
            flushed = state(F.when(kept, x["i"] - keep).otherwise(x["i"]), F.when(kept, x["kept_before"]).otherwise(before), F.lit(0), emitted(s, x["i"] - 1))
            return F.when(~too_big(s), s).when(s["fresh"] == 0, clear(s)).otherwise(flushed)

        def add(s):
            full = x["upto"] - s["base"]
            at_break, at_target = x["brk"] & (full >= sizes.least), full >= sizes.target
            kept = (F.lit(keep > 0)) & (x["i"] + 1 - s["first"] > keep)
            return (
                F.when(x["last"] | ~(at_break | at_target), state(s["first"], s["base"], s["fresh"] + 1, s["groups"]))
                .when(at_break, state(x["i"] + 1, x["upto"], F.lit(0), emitted(s, x["i"])))
                .otherwise(state(F.when(kept, x["i"] + 1 - keep).otherwise(x["i"] + 1), F.when(kept, x["kept_upto"]).otherwise(x["upto"]), F.lit(0), emitted(s, x["i"])))
            )

        return bind(bind(bind(s, make_room), make_room), add)

    finish = lambda s: F.when(s["fresh"] > 0, emitted(s, F.size(rows) - 1)).otherwise(s["groups"])
    return F.aggregate(rows, start, step, finish)


def _folded(marked: DataFrame, sizes: ChunkSizes, text: bool = False) -> DataFrame:
    """doc_id, chunk_no, first, last, char_start, char_end, and text (the sentences with one space between them) if asked for, of rows (doc_id, sent_no,
    tokens, start, end, brk, sentence). A chunk is made from its own sentences within its document's row, so no chunk carries the others'."""
    order = Window.partitionBy("doc_id").orderBy("sent_no")
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("upto", upto)
    # running totals before the sentences that an overlap starts with, if it is cut after this one or before it
    back = lambda k: F.coalesce(F.lag("upto", k).over(order), F.lit(0))
    marked = marked.withColumns({"kept_upto": back(sizes.overlap), "kept_before": back(sizes.overlap + 1), "last": F.lead("sent_no").over(order).isNull()})
    said = [normalize_space(F.col("sentence")).alias("s")] if text else []
    row = F.struct(F.col("sent_no").alias("i"), F.col("tokens").alias("tok"), "upto", "kept_upto", "kept_before", F.coalesce("brk", F.lit(False)).alias("brk"), "last", "start", "end", *said)
    rows = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def chunk(g):
        own = [F.array_join(F.transform(F.slice("rows", g["first"] + 1, g["last"] - g["first"] + 1), lambda r: r["s"]), " ").alias("text")] if text else []
        return F.struct(g["first"].alias("first"), g["last"].alias("last"), F.get("rows", g["first"])["start"].alias("char_start"), F.get("rows", g["last"])["end"].alias("char_end"), *own)

    made = rows.select("doc_id", F.posexplode(F.transform(_packed(F.col("rows"), sizes), chunk)).alias("chunk_no", "g"))
    return made.select("doc_id", "chunk_no", "g.*")


def pack_groups(sents: DataFrame, breaks: DataFrame | None = None, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """doc_id, chunk_no (from 0), first, last, char_start, char_end: runs of sentences that make the chunks of a document."""
    marked = sents.select("doc_id", "sent_no", "tokens", "start", "end")
    if breaks is None:
        marked = marked.withColumn("brk", F.lit(False))
    else:
        marked = marked.join(breaks.select("doc_id", "sent_no", F.col("is_break").alias("brk")), ["doc_id", "sent_no"], "left")
    return _folded(marked, sizes)


def chunks(pages: DataFrame, sizes: ChunkSizes = ChunkSizes(), semantic: bool = True) -> DataFrame:
    """chunk_id, doc_id, chunk_no, text (white space normalised), char_start, char_end of pages (doc_id, page_no, text)."""
    sents = hard_split(sentences(joined(pages)), sizes.most)
    # between sentences lies white space only, so theirs is the text of a chunk
    made = _folded(with_breaks(sents, sizes) if semantic else sents.withColumn("brk", F.lit(False)), sizes, text=True)
    return made.select(F.format_string("%s:%04d", F.col("doc_id").cast("string"), F.col("chunk_no")).alias("chunk_id"), "doc_id", "chunk_no", "text", "char_start", "char_end")


def chunk_spans(chunked: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id, doc_id, page_no, span_start, span_end: the part of each page that a chunk covers, page-local and half open. The first and the last
    page of a chunk are found as of its ends, so a document of many pages and chunks costs a sort of both."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    p = page_starts(pages).select("doc_id", "page_no", "start", "length").withColumn("tile", F.row_number().over(order))
    over = overlapping(chunked.select("chunk_id", "doc_id", "char_start", "char_end"), p, "doc_id", F.col("char_start"), F.col("char_end") - 1, F.col("start"), "tile")
    end = F.col("start") + F.col("length")
    lo, hi = F.greatest("char_start", "start") - F.col("start"), F.least(F.col("char_end"), end) - F.col("start")
    return over.select("chunk_id", "doc_id", "page_no", lo.alias("span_start"), hi.alias("span_end")).where("span_end > span_start")


def with_spans(chunked: DataFrame, spans: DataFrame) -> DataFrame:
    """chunks with an array `spans` of (page, start, end)."""
    each = spans.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("page"), F.col("span_start").alias("start"), F.col("span_end").alias("end")))).alias("spans"))
    return chunked.join(each, "chunk_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<page:int,start:int,end:int>>")))


def uncovered(sents: DataFrame, chunked: DataFrame) -> DataFrame:
    """Sentences whose start lies in no chunk; there should be none."""
    found = covered_until(sents.select("doc_id", "sent_no", "start"), chunked, "doc_id", "start", "char_start", "char_end")
    return found.where("until is null or until <= start").select("doc_id", "sent_no", "start")


def fixed_windows(docs: DataFrame, size: int = 160, overlap: int = 20) -> DataFrame:
    """doc_id, window_no, text, word_start, word_end: windows of words; the first that reaches the end is the last."""
    step = max(1, size - overlap)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))
    n = F.size("words")
    count = F.when(n == 0, 0).otherwise(F.greatest(F.ceil((n - size) / step), F.lit(0)) + 1).cast("int")
    windows = F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), lambda i: F.struct(F.array_join(F.slice("words", i * step + 1, F.lit(size)), " ").alias("text"), (i * step).alias("word_start"), F.least(i * step + size, n).alias("word_end")))
    return docs.select("doc_id", words.alias("words")).select("doc_id", F.posexplode(windows).alias("window_no", "w")).select("doc_id", "window_no", "w.text", "w.word_start", "w.word_end")

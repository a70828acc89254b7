"""Repeated word windows, found level by level with doubled lengths.

Level 1 looks at windows of about half the wanted length, chosen by a hash so that every wanted window
holds a chosen one at a place that depends on its words alone. Only where such a window is repeated in
another document are its places extended, to twice that length (cut to the wanted one); what is not
repeated then is no candidate any more. The doubling ends at the wanted length, since the words that a
longer repeated window covers are covered by its windows of that length.

Stretches that share a chosen window and all words around it (copies) are one class, judged by its
smallest doc_id; only the classes' first documents go to the next level. A task keeps the first document
of each class it sees and marks the others itself, so that a class of copies reaches the shuffle at most
once a task. Chosen windows with very many different surroundings (`HOT`) are dealt by those too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import segments
from .common import Words, bounded_bloom, chunks, encoded_column, grouped, parts, released, releasing, stored, table, text_bytes, windows
from .spans import PACKED, SPANS, batch, chosen, covered, dealt, ids_of, part_of, spans, unpacked, without_spans

#: Kinds of packed rows: chosen windows, and places of wanted windows.
CHOSEN, PLACES = 0, 2
#: Different surroundings of a chosen window in one chunk from which it counts as hot.
HOT = 64


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted rows, a new combination of keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _level_one(seed: int, window: int, n_parts: int):
    def run(batches):
        for b in batches:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)[valid]
            raw = encoded_column(b.column(1).filter(pa.array(valid)))
            for part in chunks([len(x) for x in raw]):
                words = Words(raw[part])
                s, _ = segments(words.hashes(), words.first, seed, window)
                if not len(s.text):
                    continue
                doc, lo = ids[part][s.text], s.lo - words.first[s.text]
                order = np.lexsort((lo, doc, s.body, s.anchor))
                anchor, body, doc, lo, n = (x[order] for x in (s.anchor, s.body, doc, lo, s.n))
                new = _starts(anchor, body)
                least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = doc > least
                rows = list(spans(doc[later], lo[later], lo[later] + n[later] - 1 + window, n_parts))
                anchor, body, doc, lo, n = (x[~later] for x in (anchor, body, doc, lo, n))
                first = _starts(anchor)
                group = np.cumsum(first) - 1
                many = (np.bincount(group, weights=_starts(anchor, body)) > HOT)[group]
                to = np.where(many, part_of(anchor ^ body, n_parts), part_of(anchor, n_parts))
                arrays = {"anchor": anchor, "body": body, "doc": doc, "lo": lo.astype(np.int32), "n": n.astype(np.int32), "hot": many.astype(np.int8)}
                rows += dealt(CHOSEN, to, arrays)
                mark = many & first  # tells the others of this anchor that it is repeated
                rows += dealt(CHOSEN, part_of(anchor[mark], n_parts), {k: v[mark] if k != "hot" else np.full(mark.sum(), 2, np.int8) for k, v in arrays.items()})
                yield batch(rows)

    return run


def _survivors(window: int, n_parts: int):
    """Chosen windows of one part: spans of later copies; places to extend, where other surroundings share the window."""

    def run(key, t):
        kind = key[0].as_py()
        if kind == SPANS:
            return t
        a = unpacked(t["body"].to_pylist())
        order = np.lexsort((a["lo"], a["doc"], a["body"], a["anchor"]))
        anchor, body, doc, lo, n, hot = (a[k][order] for k in ("anchor", "body", "doc", "lo", "n", "hot"))
        new = _starts(anchor, body)
        least = np.minimum.reduceat(np.where(hot == 2, np.iinfo(np.int64).max, doc), np.flatnonzero(new))[np.cumsum(new) - 1]
        real, later = hot < 2, doc > least
        group = np.cumsum(_starts(anchor)) - 1
        shared = (np.bincount(group, weights=new) > 1) | (np.bincount(group, weights=hot > 0) > 0)
        ask = real & ~later & shared[group]
        gone = real & later
        rows = list(spans(doc[gone], lo[gone].astype(np.int64), (lo[gone] + n[gone] - 1 + window).astype(np.int64), n_parts))
        rows += dealt(PLACES, part_of(doc[ask], n_parts), {"doc": doc[ask], "lo": lo[ask], "n": n[ask]})
        return released(pa.Table.from_batches([batch(rows)]))

    return run


def _extended(window: int, n_parts: int):
    """The hashes of the wanted windows at the surviving places of some documents."""

    def run(texts, places):
        rows = []
        if texts.num_rows and places.num_rows:
            a = unpacked(places["body"].to_pylist())
            order = np.argsort(a["doc"], kind="stable")
            ids, raw = texts["doc_id"].to_numpy(), encoded_column(texts["text"].combine_chunks())
            docs, los, ns = (a[k][order] for k in ("doc", "lo", "n"))
            for part in chunks([len(x) for x in raw]):
                words = Words(raw[part])
                every = windows(words.hashes(), window)
                hashes, doc, place = [], [], []
                for i, d in enumerate(ids[part]):
                    x, y = np.searchsorted(docs, d), np.searchsorted(docs, d, side="right")
                    at = np.repeat(los[x:y] - np.cumsum(ns[x:y]) + ns[x:y], ns[x:y]) + np.arange(int(ns[x:y].sum()))
                    at = at[at + window <= words.first[i + 1] - words.first[i]]
                    hashes.append(every[words.first[i] + at] if len(at) else np.zeros(0, np.uint64))
                    doc.append(np.full(len(at), d))
                    place.append(at)
                h, doc, place = (np.concatenate(x) for x in (hashes, doc, place))
                rows += _judged(h, doc, place, window, n_parts, True)
        return released(pa.Table.from_batches([batch(rows)]))

    return run


def _judged(h, doc, place, window, n_parts, hand_on):
    """Spans of windows that start in a smaller document among these; what may yet be, if handed on."""
    order = np.lexsort((place, doc, h))
    h, doc, place = h[order], doc[order], place[order].astype(np.int64)
    new = _starts(h)
    later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else np.zeros(0, bool)
    rows = list(spans(doc[later], place[later], place[later] + window, n_parts))
    if hand_on:
        rows += dealt(PLACES, part_of(h[~later], n_parts), {"h": h[~later], "doc": doc[~later], "place": place[~later].astype(np.int32)})
    return rows


def _last_level(window: int, n_parts: int):
    def run(key, t):
        if key[0].as_py() == SPANS:
            return t
        a = unpacked(t["body"].to_pylist())
        return pa.Table.from_batches([batch(_judged(a["h"], a["doc"], a["place"], window, n_parts, False))])

    return run


def repeated_windows(docs: DataFrame, n: int, window: int = 13) -> DataFrame:
    """Packed rows of spans, in n parts, of words of docs (doc_id, text) that lie in a window of `window` words that also
    starts in a document with a smaller doc_id."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    one = grouped(rows.mapInArrow(releasing(_level_one((window + 1) // 2, window, n)), PACKED), n, "kind", "part").applyInArrow(_survivors(window, n), PACKED)
    one = stored(one, "level-one")
    places = one.where(F.col("kind") == PLACES)
    texts = chosen(rows, bounded_bloom(ids_of(places), "doc_id"), n)
    two = grouped(texts, n, "part").cogroup(grouped(places, n, "part")).applyInArrow(_extended(window, n), PACKED)
    two = stored(grouped(two, n, "kind", "part").applyInArrow(_last_level(window, n), PACKED), "level-two")
    return one.where(F.col("kind") == SPANS).unionByName(two.where(F.col("kind") == SPANS))


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has none. A row with a null doc_id takes no part:
    it keeps all words and removes none. Rows that share a doc_id are one document to the others; a span of
    words found in one is removed from each. Other columns are ignored; an empty table gives no rows.
    """

    def finish(text, starts, ends):
        words = text.split()
        if len(starts):
            gone = covered(len(words), starts, ends)
            kept = [w for w, g in zip(words, gone) if not g]
        else:
            kept = words
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    n = parts(docs.sparkSession, text_bytes(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    return without_spans(rows, repeated_windows(docs, n, window), n, finish, "n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}

"""Removal of repeated byte strings with suffix arrays, a shard at a time.

1. Windows of the wanted length are gathered into segments by their anchors (see anchors.py). Equal windows
   lie in segments of one anchor hash. Segments that are equal as a whole are one string: where it occurs
   twice, all its windows are repeats, and one of them stands for all.
2. Different strings of one anchor hash go to one shard, and lie in one slice of it: equal windows have one
   anchor, so slices of some anchors each are independent, and only one is in memory. A slice lays its strings
   end to end, sorts their suffixes by Larsson and Sadakane's refinement (the order by 8, 16, 32, ... bytes; only
   groups still unsorted are sorted again) and finds the common prefixes of neighbours by Kasai's scan, in lock
   step over the segments. A window is a repeat if its suffix shares the wanted length with a neighbour.
3. Anchors with very many different strings are dealt over several shards and slices. Each of these hands on
   its windows in sorted runs of keys, cut into ranges; a merge of a range looks each run's keys up in the
   others by binary search.

Rows are told apart by a 64-bit hash of doc_id and text, so that texts may share an id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Rolling, segments
from .common import bounded_bloom, chunks, encoded_column, grouped, is_space, mix, parts, released, releasing, stored, table, text_bytes
from .spans import PACKED, SPANS, batch, chosen, covered, dealt, ids_of, pack, part_of, spans, unpacked, without_spans

#: Kinds of packed rows: segments, segments whose bytes are asked for, strings of a shard, keys to merge.
SEGMENTS, ASKED, STRINGS, KEYS = 0, 2, 3, 4
#: Different strings of an anchor from which it is dealt over several shards: in one chunk, and in all.
HOT, HOT_ALL = 64, 2048
#: Bytes of strings that a shard sorts at a time, or one anchor's if they are more: sorting takes some 80 times as many.
SLICE = 1 << 19
#: A symbol for each byte; any odd multiples do.
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))
_BREAK = 0xFF  # occurs in no UTF-8 text


def suffix_array(data: np.ndarray, length: int):
    """Places of data (uint8) in the order of their suffixes, as far as the first `length` bytes tell; and ranks by
    a depth of at least half as many bytes, with that depth: places of one rank share so many."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(head, n))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(head + 1, size)  # 0 is past the end
    at = np.flatnonzero(np.repeat(size > 1, size))  # places in the order whose groups are unsorted
    h, coarse = 8, None
    while h < length and len(at):
        if 2 * h >= length:
            coarse, depth = rank.copy(), h
        place = order[at]
        group, next_ = rank[place], rank[np.minimum(place + h, n)]
        by = np.argsort(group * (n + 2) + next_)
        place, group, next_ = place[by], group[by], next_[by]
        order[at] = place
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        rank[place] = np.repeat(at[head] + 1, size)
        at = at[np.repeat(size > 1, size)]
        h *= 2
    return (order, rank, h) if coarse is None else (order, coarse, depth)


def common_prefixes(data: np.ndarray, sorted_: tuple, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """By Kasai's scan, how many bytes (up to most) the suffix at each rank shares with the one before it; known for the
    suffixes that start in the first counts[i] places from starts[i]. All stretches are scanned in step.

    sorted_: what suffix_array returned for `most`. Suffixes that share more than it sorted by are in any order, and
    so the next two places need not share one byte less: after a full match the ranks by depth confirm it."""
    order, coarse, depth = sorted_
    n = len(data)
    rank = np.zeros(n, np.int64)
    rank[order] = np.arange(n)
    joined = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    shared = np.zeros(n, np.int32)
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -t))  # of the stretches, longest first, those with a place t
        p = starts[:live] + t
        r = rank[p]
        q = order[r - 1]
        own = np.maximum(h[:live] - 1, 0)
        going = np.flatnonzero(r > 0)
        own[r == 0] = 0
        full = np.flatnonzero(h[:live] >= most)
        if len(full):
            a, b, more = p[full], q[full], max(0, most - 1 - depth)
            same = (coarse[a] == coarse[b]) & (coarse[np.minimum(a + more, n)] == coarse[np.minimum(b + more, n)])
            own[full[~same]] = 0
        while len(going):
            differ = words[p[going] + own[going]] ^ words[q[going] + own[going]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            own[going] = np.minimum(own[going] + same, most)
            going = going[(same == 8) & (own[going] < most)]
        h[:live] = own
        shared[r] = own
    return shared


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _segments(seed: int, window: int, n_parts: int):
    def run(batches):
        for b in batches:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)[valid]
            raw = encoded_column(b.column(1).filter(pa.array(valid)))
            for part in chunks([len(x) for x in raw], 1 << 19):  # a byte takes some 80 while its segments are made
                some = raw[part]
                first = np.cumsum([0] + [len(x) for x in some])
                s, _ = segments(SYMBOLS[np.frombuffer(b"".join(some), np.uint8)], first, seed, window)
                if not len(s.text):
                    continue
                order = np.lexsort((s.body, s.anchor))
                anchor, body, doc, n = (x[order] for x in (s.anchor, s.body, ids[part][s.text], s.n))
                lo = (s.lo - first[s.text])[order]
                new = _starts(anchor, body)
                string = np.cumsum(new) - 1
                twice = (np.bincount(string) > 1)[string]
                rows = list(spans(doc[twice], lo[twice], lo[twice] + n[twice] - 1 + window, n_parts))
                anchor, body, doc, lo, n, twice = (x[new] for x in (anchor, body, doc, lo, n, twice))
                head = _starts(anchor)
                group = np.cumsum(head) - 1
                many = (np.bincount(group) > HOT)[group]
                arrays = {"anchor": anchor, "body": body, "doc": doc, "lo": lo.astype(np.int32), "n": n.astype(np.int32), "known": twice.astype(np.int8), "hot": many.astype(np.int8)}
                rows += dealt(SEGMENTS, np.where(many, part_of(anchor ^ body, n_parts), part_of(anchor, n_parts)), arrays)
                mark = many & head
                rows += dealt(SEGMENTS, part_of(anchor[mark], n_parts), {k: v[mark] if k != "hot" else np.full(mark.sum(), 2, np.int8) for k, v in arrays.items()})
                yield batch(rows)

    return run


def _strings(window: int, n_parts: int):
    """Segments of one part: spans of strings that occur twice; one of each string whose anchor has others."""

    def run(key, t):
        if key[0].as_py() == SPANS:
            return t
        a = unpacked(t["body"].to_pylist())
        order = np.lexsort((a["hot"], a["body"], a["anchor"]))
        anchor, body, doc, lo, n, known, hot = (a[k][order] for k in ("anchor", "body", "doc", "lo", "n", "known", "hot"))
        group = np.cumsum(_starts(anchor)) - 1
        spread = np.bincount(group, weights=hot > 0) > 0  # some strings of this anchor are dealt elsewhere
        real = hot < 2
        anchor, body, doc, lo, n, known, hot, group = (x[real] for x in (anchor, body, doc, lo, n, known, hot, group))
        new = _starts(anchor, body)
        string = np.cumsum(new) - 1
        twice = (np.bincount(string) > 1)[string]
        repeated = twice | (np.bincount(string, weights=known) > 0)[string]
        fresh = twice & (known == 0)
        rows = list(spans(doc[fresh], lo[fresh].astype(np.int64), (lo[fresh] + n[fresh] - 1 + window).astype(np.int64), n_parts))
        different = np.bincount(group, weights=new, minlength=len(spread))
        many = (different > HOT_ALL) | spread
        ask = new & ((different > 1) | spread)[group]
        rows += dealt(ASKED, part_of(doc[ask], n_parts), {"anchor": anchor[ask], "body": body[ask], "doc": doc[ask], "lo": lo[ask], "n": n[ask], "known": repeated[ask].astype(np.int8), "hot": many[group][ask].astype(np.int8)})
        return released(pa.Table.from_batches([batch(rows)]))

    return run


def _bytes_of(window: int, n_parts: int):
    """Strings asked for, cut from some documents and dealt to shards."""

    def run(texts, asked):
        rows = []
        if texts.num_rows and asked.num_rows:
            a = unpacked(asked["body"].to_pylist())
            whole, at, end = bytearray(), {}, 0
            for d, x in zip(texts["doc_id"].to_pylist(), encoded_column(texts["text"].combine_chunks())):
                if d not in at:
                    at[d] = (end, len(x))
                    whole += x
                    end += len(x)
            data = np.frombuffer(bytes(whole), np.uint8)
            base = np.array([at.get(d, (-1, 0)) for d in a["doc"].tolist()], np.int64).reshape(-1, 2)
            size = a["n"].astype(np.int64) - 1 + window
            fine = (base[:, 0] >= 0) & (a["lo"] + size <= base[:, 1])
            a = {k: v[fine] for k, v in a.items()}
            base, size = base[fine, 0] + a["lo"], size[fine]
            shard = np.where(a["hot"] > 0, part_of(a["anchor"] ^ a["body"], n_parts), part_of(a["anchor"], n_parts))
            order = np.argsort(shard, kind="stable")
            for s in np.unique(shard):
                mine = order[np.searchsorted(shard[order], s) : np.searchsorted(shard[order], s, side="right")]
                m = size[mine]
                ends = np.cumsum(m)
                text = data[np.repeat(base[mine] - ends + m, m) + np.arange(int(m.sum()))]
                packed = {k: a[k][mine] for k in ("anchor", "doc", "lo", "n", "known", "hot")}
                packed["text"] = text
                rows.append((STRINGS, int(s), pack(packed)))
        return released(pa.Table.from_batches([batch(rows)]))

    return run


def _slices(anchor: np.ndarray, size: np.ndarray, hot: np.ndarray):
    """Strings of a shard in slices of about SLICE bytes: all of an anchor's in one, unless it is hot."""
    order = np.lexsort((anchor, hot))
    unit = np.flatnonzero(_starts(anchor[order]) | hot[order])
    yield from (order[unit[s.start] : unit[s.stop] if s.stop < len(unit) else len(order)] for s in chunks(np.add.reduceat(size[order], unit).tolist() if len(unit) else [], SLICE))


def _repeated(text: np.ndarray, n: np.ndarray, known: np.ndarray, window: int):
    """For strings laid end to end, with n windows each: the text with breaks, each window's place there, whether it is a
    repeat, and whether an equal one was sorted before it."""
    size = n - 1 + window
    start = np.cumsum(size + 1) - size - 1
    data = np.full(int((size + 1).sum()), _BREAK, np.uint8)
    data[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = text
    sorted_ = suffix_array(data, window)
    order = sorted_[0]
    full = np.flatnonzero(common_prefixes(data, sorted_, start, n, window) >= window)
    repeated, again = np.zeros(len(data), bool), np.zeros(len(data), bool)
    repeated[order[full]] = repeated[order[full - 1]] = again[order[full]] = True
    place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return data, place, repeated[place], again[place]


def _shard(window: int, n_parts: int):
    """Suffix arrays and common prefixes of one shard's strings, slice by slice."""

    def run(key, t):
        if key[0].as_py() == SPANS:
            return t
        a = unpacked(t["body"].to_pylist())
        count, hot, known = a["n"].astype(np.int64), a["hot"] > 0, a["known"] > 0
        size = count - 1 + window
        at = np.cumsum(size) - size
        rows, found = [], []
        for k, mine in enumerate(_slices(a["anchor"], size, hot)):
            n, m = count[mine], size[mine]
            text = a["text"][np.repeat(at[mine] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
            data, place, repeated, again = _repeated(text, n, known[mine], window)
            segment = np.repeat(np.arange(len(n)), n)
            lo = a["lo"][mine].astype(np.int64)[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
            hit = repeated & ~known[mine][segment]
            # runs of windows of one string
            edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & (segment[1:] == segment[:-1]))))
            last = np.flatnonzero(hit & ~np.concatenate((hit[1:] & (segment[1:] == segment[:-1]), [False])))
            found.append((a["doc"][mine][segment[edge]], lo[edge], lo[last] + window))
            # one key of each window of hot anchors: repeated ones are told of by the first of their group
            send = np.flatnonzero(hot[mine][segment] & ~again)
            if len(send):
                keys = Rolling(SYMBOLS[data])(place[send], place[send] + window)
                told = repeated[send] | known[mine][segment[send]]
                cut = (keys >> np.uint64(40)) * np.uint64(n_parts) >> np.uint64(24)  # equal ranges of keys
                rows += dealt(KEYS, cut.astype(np.int32), {"key": keys, "doc": a["doc"][mine][segment[send]], "lo": lo[send].astype(np.int32), "told": told.astype(np.int8), "run": np.full(len(keys), key[1].as_py() << 32 | k, np.int64)})
        if found:
            rows += spans(*(np.concatenate(x) for x in zip(*found)), n_parts)
        return released(pa.Table.from_batches([batch(rows)]))

    return run


def _merged(window: int, n_parts: int):
    """One range of the keys of several shards: those that another shard's run holds too."""

    def run(key, t):
        if key[0].as_py() == SPANS:
            return t
        a = unpacked(t["body"].to_pylist())
        order = np.lexsort((a["key"], a["run"]))
        a = {k: v[order] for k, v in a.items()}
        edges = np.append(np.flatnonzero(_starts(a["run"])), len(order))
        runs = [a["key"][i:j] for i, j in zip(edges, edges[1:])]
        merged = np.sort(np.concatenate([np.unique(r) for r in runs]))
        found = np.concatenate([np.searchsorted(merged, r, side="right") - np.searchsorted(merged, r) > 1 for r in runs])
        found &= a["told"] == 0
        lo = a["lo"][found].astype(np.int64)
        return released(pa.Table.from_batches([batch(list(spans(a["doc"][found], lo, lo + window, n_parts)))]))

    return run


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """_row (a hash of doc_id and text), text and more columns."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_row"), "text", *[F.col(f"`{c}`") for c in more])


def repeated_bytes(rows: DataFrame, n: int, window: int = 400) -> DataFrame:
    """Packed rows of spans, in n parts, of UTF-8 bytes of rows (key, text) that lie in a string of `window` bytes which
    also starts anywhere else."""
    rows = rows.select(F.col(rows.columns[0]).alias("doc_id"), "text")
    found = grouped(rows.mapInArrow(releasing(_segments(max(1, window // 2), window, n)), PACKED), n, "kind", "part").applyInArrow(_strings(window, n), PACKED)
    found = stored(found, "strings")
    asked = found.where(F.col("kind") == ASKED)
    texts = chosen(rows, bounded_bloom(ids_of(asked), "doc_id"), n)
    strings = grouped(texts, n, "part").cogroup(grouped(asked, n, "part")).applyInArrow(_bytes_of(window, n), PACKED)
    shards = grouped(strings, n, "kind", "part").applyInArrow(_shard(window, n), PACKED)
    merged = stored(grouped(shards, n, "kind", "part").applyInArrow(_merged(window, n), PACKED), "merged")
    return found.where(F.col("kind") == SPANS).unionByName(merged.where(F.col("kind") == SPANS))


def suffix_array_dedup(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text): what stays of the UTF-8 bytes
    without each byte covered by a string of `window` bytes that also starts anywhere else.

    Matches do not cross rows and are judged on the input; occurrences may overlap. A null text is empty. Each row is
    a document of its own, whatever its doc_id: rows may share one, with or without a common text, or have none, and
    repeated rows repeat each other's strings. Other columns are ignored; an empty table gives no rows.
    """

    def finish(text, starts, ends):
        if not len(starts):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        gone = covered(len(text), starts, ends)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        runs = int(_runs(gone))
        return len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()

    n, rows = parts(docs.sparkSession, text_bytes(docs)), _keyed(docs, "doc_id")
    return without_spans(rows, repeated_bytes(rows, n, window), n, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def without_repeats(docs: DataFrame, window: int = 400, words: int = 0, nbytes: int = 0) -> DataFrame:
    """docs with what suffix_array_dedup keeps of each text; other columns stay. A character of which only some bytes
    are kept goes; a null text becomes an empty one. Null, shared and repeated doc_ids are as there: each row is
    judged by itself. An empty table gives no rows. words, nbytes: of the runs found, those with fewer words and fewer
    bytes than these stay; a word of which a run has a part counts."""

    def finish(text, starts, ends):
        if len(starts):
            data, gone = np.frombuffer(text, np.uint8), covered(len(text), starts, ends)
            text = data[~(_long(data, gone, words, nbytes) if words else gone)].tobytes()
        return (text.decode("utf-8", "ignore"),)

    n, others = parts(docs.sparkSession, text_bytes(docs)), [c for c in docs.columns if c != "text"]
    found = repeated_bytes(_keyed(docs), n, window)
    return without_spans(_keyed(docs, *others), found, n, finish, "text string").select(*[F.col(f"`{c}`") for c in docs.columns])


def _long(data: np.ndarray, gone: np.ndarray, words: int, nbytes: int) -> np.ndarray:
    """Of the places that are gone, those in runs of so many words or so many bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    first, size = edge[::2], edge[1::2] - edge[::2]
    within = gone & ~is_space(data)
    begins = within & ~np.concatenate(([False], within[:-1]))
    long = (np.add.reduceat(begins, first, dtype=np.int64) >= words) | (size >= nbytes)
    out = np.zeros(len(gone), bool)
    out[gone] = np.repeat(long, size)
    return out


def _runs(gone: np.ndarray) -> int:
    return int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}

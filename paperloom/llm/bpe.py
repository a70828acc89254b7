"""Byte-level BPE, encoded by Spark's higher-order functions and decoded by concatenation.

Texts are cut into pieces and gathered into bundles. A bundle's distinct pieces are rows, one each, followed by a
row with its texts as places in that list. For each piece an `aggregate` folds the ranked merges over an array of
symbols; the rank of a pair comes from a literal table (rows of a sparse table laid over one another, so that a
lookup is two array reads). Pieces of a sample of the texts, of fixed size, are encoded first, by the same fold, and
once for all bundles, which then have only their other pieces folded. Nothing else is shuffled or collected.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import chunks, released, releasing, table, text_bytes, worker_value

#: Bytes of text in a bundle; longer texts are alone in theirs.
BUNDLE = 32 << 20
#: Bytes of text whose pieces are encoded once for all bundles; texts of less than twice as much have no such pieces.
SAMPLE = 32 << 20
#: Pieces of more bytes are encoded with a heap, since a fold's time grows with the square of the length.
LONG = 64
BUNDLE_TYPE = "piece array<int>, payload binary"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """For symbols a and b that together are a symbol: key a << 16 | b, and its rank."""
    return {ranks[t[:i]] << 16 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


@cache
def _literals(path: str) -> tuple[str, str, str]:
    """JSON of the rank map of pairs and of the symbols of single bytes.

    The map is a sparse table, a row for each left symbol, whose rows are laid over one another so that
    no two entries meet: the entry of (a, b) is slots[base[a] + b], as a << 16 | rank, and null where there is
    none (a null costs no further access to memory). Rows go in from the fullest, each to the first place where it fits.
    """
    ranks = read_ranks(path)
    width = max(ranks.values()) + 1
    if width > 1 << 16:
        raise ValueError("ranks above 65535 do not fit the map of pairs")
    rows = defaultdict(list)
    for key, rank in pair_ranks(ranks).items():
        rows[key >> 16].append((key & 65535, rank))
    slots = np.full(4 * width + 2 * sum(map(len, rows.values())), -1, np.int64)
    used, base, free, span = slots >= 0, np.zeros(width, np.int64), width, 4096
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        at, rank = (np.array(x, np.int64) for x in zip(*sorted(row)))
        free += int(np.argmin(used[free:]))
        for place in range(free, len(slots) - width - span, span):
            taken = used[place : place + span].copy()
            for x in at[1:] - at[0]:
                taken |= used[place + x : place + x + span]
            if not taken.all():
                break
        else:
            raise ValueError("the map of pairs is too full")
        base[a] = place + int(np.argmin(taken)) - at[0]
        slots[base[a] + at], used[base[a] + at] = a << 16 | rank, True
    top = int(np.flatnonzero(slots >= 0).max()) + 1
    text = lambda x: json.dumps(x, separators=(",", ":"))
    return text([x if x >= 0 else None for x in slots[:top].tolist()]), text(base.tolist()), text([ranks[bytes([i])] for i in range(256)])


def _merged(piece: Column, slots: Column, base: Column, single: Column) -> Column:
    """Ids of one piece (an array of bytes): the lowest-ranked, leftmost pair is merged until none has a rank."""
    one = lambda x, use: F.transform(F.array(x), use)[0]  # noqa: E731  use(x), with x computed once

    def step(p, _):
        # of a pair in the map the entry differs from a << 16 by the rank alone; else it is null or differs by more
        pair = lambda a, i: F.get(slots, F.get(base, a) + F.get(p, i + 1)).bitwiseXOR(F.shiftleft(a.cast("bigint"), 16))

        def merge(ranks):
            def put(k):
                m = F.get(ranks, k - 1)
                joined = F.array_remove(F.transform(p, lambda x, i: F.when(i == k - 1, m.cast("int")).when(i == k, -2).otherwise(x)), -2)
                # a last symbol of -1 says that no pair is left
                return F.when(m < 1 << 16, joined).otherwise(F.concat(p, F.array(F.lit(-1))))

            return one(F.array_position(ranks, F.array_min(ranks)).cast("int"), put)

        return F.when(F.get(p, F.size(p) - 1) < 0, p).otherwise(one(F.transform(p, pair), merge))

    return F.array_remove(F.aggregate(piece, F.transform(piece, lambda x: F.get(single, x)), step), -1)


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs: for long pieces."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Places(dict):
    """Distinct keys by the order of their first use; learn(key) is called at it."""

    def __init__(self, learn=None):
        self.learn = learn

    def __missing__(self, key):
        n = self[key] = len(self)
        if self.learn:
            self.learn(key)
        return n


def _split(spaced: bool):
    """A function that cuts a text into units that are matched apart (see _bundles)."""
    blank, cut = re.compile(r"\s ").search, re.compile(r"(?<!\s) ").split

    def split(text):
        if not spaced:
            return [text]
        first, *rest = text.split(" ") if not blank(text) else cut(text)
        return [first, *map(" ".__add__, rest)]

    return split


def _lists(pieces: list[bytes]):
    """Arrow lists of the bytes of each piece, some at a time."""
    raw, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0] + [len(p) for p in pieces])
    for i in range(0, len(pieces), 4000):
        some = ends[i : i + 4001]
        yield pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(raw[some[0] : some[-1]].astype(np.int32)))


def _short_pieces(pattern: str, spaced: bool):
    """Texts into the distinct pieces of all, but for long ones."""

    def run(batches):
        import regex

        find, split, units = regex.compile(pattern).findall, _split(spaced), set()
        for b in batches:
            for text in b.column(0):
                if text := text.as_py():
                    units.update(split(text))
        pieces = {p for x in units for p in find(x)}
        for lists in _lists([x for p in pieces if len(x := p.encode("utf-8", "surrogatepass")) <= LONG]):
            yield pa.RecordBatch.from_arrays([lists], names=["piece"])

    return releasing(run)


class _Common:
    """Pieces that are encoded once for all bundles: their bytes, and their ids end to end."""

    def __init__(self, found: pa.Table):
        piece, ids = (found.column(c).combine_chunks() for c in ("piece", "ids"))
        ends = np.concatenate(([0], np.cumsum(np.asarray(piece.value_lengths(), np.int64)))).astype(np.int32)
        raw = piece.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
        self.pieces = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
        self.n = np.asarray(ids.value_lengths(), np.int64)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


def _bundles(pattern: str, spaced: bool, common: pa.Array | None = None):
    """Rows (doc_id, text) into bundles: a row for each distinct piece, and one with the texts as places among them.

    spaced: after a character that is no white space, a space always begins a match, and letters after it end one only with
    the last of them. Then a text falls at such spaces into units that are matched apart, and each distinct unit of a
    bundle is matched once. common: pieces that get no row, as places among them will do."""

    def run(batches):
        import regex

        find, split = regex.compile(pattern).findall, _split(spaced)
        keys, sizes, codes, held = [], [], [], 0
        n, flat, place = array("i"), array("i"), _Places()

        def learn(x):
            if spaced and x[:1] == " " and x[1:].isalpha():  # one match, as letters after a space are
                n.append(1)
                flat.append(place[x])
            else:
                found = find(x)
                n.append(len(found))
                flat.extend(map(place.__getitem__, found))

        unit = _Places(learn)

        def out():
            nonlocal keys, sizes, codes, held, n, flat, place, unit
            pieces, head = [p.encode("utf-8", "surrogatepass") for p in place], {"key": [None if k is None else int(k) for k in keys], "size": sizes, "units": len(n)}
            body = [n.tobytes(), np.array([len(flat)], np.int64).tobytes(), flat.tobytes(), *codes]
            # the words are let go before their pieces are folded
            keys, sizes, codes, held = [], [], [], 0
            n, flat, place, unit = array("i"), array("i"), _Places(), _Places(learn)
            released()
            known = np.full(len(pieces), -1, np.int32)
            if common is not None:
                known = pc.index_in(pa.array(pieces, pa.binary()), value_set=common).fill_null(-1).to_numpy(zero_copy_only=False)
            head = json.dumps(head | {"pieces": len(pieces)}).encode()
            payload = zstandard.ZstdCompressor(1).compress(b"".join([len(head).to_bytes(8, "little"), head, *body[:3], known.tobytes(), *(c.tobytes() for c in body[3:])]))
            pieces, body = [pieces[i] for i in np.flatnonzero(known < 0).tolist()], None
            released()
            for lists in _lists(pieces):
                yield pa.RecordBatch.from_arrays([lists, pa.nulls(len(lists), pa.binary())], names=["piece", "payload"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(pa.int32())), pa.array([payload], pa.binary())], names=["piece", "payload"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                mine = split(text) if text else []
                keys.append(key)
                sizes.append(len(mine))
                codes.append(np.fromiter(map(unit.__getitem__, mine), np.int32, len(mine)))
                held += len(text)
                if held >= BUNDLE:
                    yield from out()
        if keys:
            yield from out()

    return releasing(run)


def _opened(payload: bytes):
    """Keys, units of each text, and of all texts; for each unit its pieces: how many, and which; and for each piece its place
    among the common ones, or -1."""
    body = zstandard.ZstdDecompressor().decompress(payload)
    at = 8 + int.from_bytes(body[:8], "little")
    head = json.loads(body[8:at])
    n = np.frombuffer(body, np.int32, head["units"], at)
    total = int.from_bytes(body[at + n.nbytes : at + n.nbytes + 8], "little")
    flat = np.frombuffer(body, np.int32, total, at + n.nbytes + 8)
    known = np.frombuffer(body, np.int32, head["pieces"], at + n.nbytes + 8 + flat.nbytes)
    return head["key"], np.array(head["size"], np.int64), np.frombuffer(body, np.int32, offset=at + n.nbytes + 8 + flat.nbytes + known.nbytes), n.astype(np.int64), flat, known


def _chosen(pool: np.ndarray, start: np.ndarray, n: np.ndarray, which: np.ndarray):
    """The stretches pool[start[i] : start[i] + n[i]] for i of which, end to end, and how long each is."""
    m = n[which]
    ends = np.cumsum(m)
    return pool[np.repeat(start[which] - ends + m, m) + np.arange(int(ends[-1]) if len(ends) else 0)], m


def _gather(path: str, finish=None, common_n=np.zeros(0, np.int64), common_ids=np.zeros(0, np.int32)):
    """Ids of distinct pieces, and the texts after them, into batches (doc_id, ids), or finish(batch) of each. common_n and
    common_ids: how many ids each common piece has, and all of them."""

    def bundle(payload, ids, n):
        keys, sizes, codes, unit_n, flat, known = _opened(payload)
        # ids of common pieces stand after those of the rows
        each = np.concatenate([n, common_n])
        of = known.astype(np.int64) + len(n)
        of[known < 0] = np.arange(len(n))
        pool, m = _chosen(np.concatenate([ids, common_ids]), (np.cumsum(each) - each)[of], each[of], flat)  # of units, in place of pieces
        size = np.add.reduceat(np.append(m, 0), np.cumsum(unit_n) - unit_n) * (unit_n > 0) if len(unit_n) else np.zeros(0, np.int64)
        start, done = np.cumsum(size) - size, np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate(([0], np.cumsum(size[codes])))[done]  # ids before each text
        for first, last in ((s.start, s.stop) for s in chunks(np.diff(total).tolist(), 1 << 20)):
            out, _ = _chosen(pool, start, size, codes[done[first] : done[last]])
            lists = pa.ListArray.from_arrays(pa.array(total[first : last + 1] - total[first], pa.int32()), pa.array(out, pa.int32()))
            some = pa.RecordBatch.from_arrays([pa.array(keys[first:last], pa.int64()), lists], names=["doc_id", "ids"])
            yield finish(some) if finish else some

    def run(batches):
        ranks, held, sizes = None, [], []
        for b in batches:
            lists, long, payload = b.column(0), b.column(1), b.column(2)
            edge = [*np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False)).tolist(), b.num_rows]
            first = 0
            for at in edge:
                some, more = lists.slice(first, at - first), long.slice(first, at - first)
                if more.null_count == len(more):
                    held.append(np.asarray(some.flatten(), np.int32))
                    sizes.append(np.asarray(some.value_lengths(), np.int64))
                else:
                    ranks = ranks or read_ranks(path)
                    each = [np.array(heap_merge(bytes(x), ranks) if x is not None else i, np.int32) for i, x in zip(some.to_pylist(), more.to_pylist())]
                    held.append(np.concatenate(each))
                    sizes.append(np.array([len(x) for x in each], np.int64))
                if at < b.num_rows:
                    none = np.zeros(0, np.int32)
                    yield from bundle(payload[at].as_py(), np.concatenate([none, *held]), np.concatenate([none.astype(np.int64), *sizes]))
                    held, sizes = [], []
                first = at + 1

    return releasing(run)


def encode(docs: DataFrame, ranks: str, pattern: str, finish=None, schema: str = "doc_id long, ids array<int>", spaced: bool | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs (doc_id, text), as tiktoken encodes ordinary text.

    A null or empty text has no ids; repeated rows are repeated; null doc_ids stay null; other columns
    are ignored. ranks: a rank file; pattern: what cuts a text into pieces. finish: turns each Arrow batch of
    the result into one of `schema` in the same pass. spaced: whether a space after other than white space always begins
    a piece, with all letters that follow it, as in the default pattern; false if not said of another one. Of much text, a
    sample is read first, for pieces to encode once; which these are changes no result.
    """
    if spaced is None:
        spaced = pattern == default_pattern()
    slots, base, single = (F.from_json(F.lit(x), kind) for x, kind in zip(_literals(ranks), ("array<bigint>", "array<int>", "array<int>")))
    folded = _merged(F.col("piece"), slots, base, single)
    pieces, given = None, ()
    if (total := text_bytes(docs)) >= 2 * SAMPLE:
        some = docs.select("text").sample(SAMPLE / total, 7).mapInArrow(_short_pieces(pattern, spaced), "piece array<int>").distinct()
        common = _Common(some.select("piece", folded.alias("ids")).toArrow())
        pieces, given = common.pieces, (common.n, common.ids)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_bundles(pattern, spaced, pieces), BUNDLE_TYPE)
    short = F.size("piece") <= LONG
    ids = F.when(short, folded)
    return rows.select(ids.alias("ids"), F.when(~short, F.col("piece")).alias("long_piece"), "payload").mapInArrow(_gather(ranks, finish, *given), schema)


class _Strings:
    """A byte string for each id, and their concatenation for lists of ids."""

    def __init__(self, of_id: dict[int, bytes]):
        each = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.n = np.array([len(x) for x in each], np.int64)
        self.start, self.pool = np.cumsum(self.n) - self.n, np.frombuffer(b"".join(each), np.uint8)

    def joined(self, lists) -> pa.Array:
        """The strings of each list of ids, joined; null for null."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        out, m = _chosen(self.pool, self.start, self.n, ids)
        ends = np.concatenate(([0], np.cumsum(m)))[np.concatenate(([0], np.cumsum(sizes)))]
        valid = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [valid, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])


def decoder(ranks: str):
    """A function that adds to an Arrow batch with a column `ids` the column `bytes`: the binary pieces of the
    ids, joined; null for null."""

    def run(batch):
        pieces = worker_value(("symbols", ranks), lambda: _Strings({r: t for t, r in read_ranks(ranks).items()}))
        whole = pieces.joined(batch.column(batch.schema.names.index("ids"))).cast(pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, whole], names=[*batch.schema.names, "bytes"])

    return run


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded (ids and any other columns but `bytes`, which is replaced) with a column `bytes`: the pieces of the ids joined;
    empty for no ids, null for null. Rows keep their number and order; an empty table gives no rows. Spark's own functions
    can join pieces only as hexadecimal text, at twice the memory, so numpy does it."""
    run, encoded = decoder(ranks), encoded.drop("bytes")
    return encoded.mapInArrow(releasing(lambda batches: map(run, batches)), StructType([*encoded.schema.fields]).add("bytes", BinaryType()))


def _digests(batch):
    c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    decimal = worker_value("decimals", lambda: _Strings({i: b"%d," % i for i in range(1 << 16)}))
    sha = lambda column, drop: pa.array([hashlib.sha256(x.as_buffer()[: x.as_buffer().size - drop]).hexdigest() if x.as_buffer().size else hashlib.sha256().hexdigest() for x in column])
    return pa.RecordBatch.from_pydict({"doc_id": c["doc_id"], "n_tokens": c["ids"].value_lengths().cast(pa.int64()), "ids_sha256": sha(decimal.joined(c["ids"]), 1), "decoded_sha256": sha(c["bytes"], 0)})


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_ranks()
    decoded = decoder(path)
    return encode(table(spark, sf_dir, "documents"), path, default_pattern(), lambda batch: _digests(decoded(batch)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op10_byte_bpe": op10_byte_bpe}

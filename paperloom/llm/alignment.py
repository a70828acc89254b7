"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how good each link is.

Both tokenizers cut a document's bytes; where both cuts fall together a group ends, and two tokens are linked where
their bytes overlap. Whether a link is the best for its second token is a matter of the whole corpus, so what each
document holds of each pair of ids is shuffled by the second id (the side id). A part gets, in one sorted stream, the
totals of a side id before all postings of it; it keeps these totals, at most one for each id of the first vocabulary, and passes
postings on as what they add to their documents, which is summed by document. The stream is sorted by Spark, which spills.
A side id with very many postings is dealt over several parts, each of which gets its totals.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, encoded_column, releasing, stored, table, worker_value

#: Text bytes of a chunk of documents, whose postings of a side id are one row; postings of a side id that stay together; document
#: sums that a part holds before it passes them on.
CHUNK, TOGETHER, HELD = 2 << 20, 1 << 22, 1 << 20

_DOCUMENT = "chunk long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "chunk long, documents int, side int, ids array<int>, counts array<long>, many array<int>, rows array<int>, times array<int>"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies are written in: bytes that print stand for themselves, the others for letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """A byte-level vocabulary file of the tokenizers library (a) and a model file of sentencepiece (b): ids of space and text, and the
    bytes of each id. The merges of a are run by tiktoken, which gives the same ids faster, where its pattern is the usual one."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a)
        self.slow.encode_special_tokens = True
        letters = _byte_letters()
        with open(a, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a_bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.fast = tiktoken.Encoding("a", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # how an id is written where it begins a group, a side or neither: a after ';' or ',', b after '|' or ','
        self.written = [f"{sep}{i}".encode() for sep, n in ((";", len(self.a_bytes)), (",", len(self.a_bytes)), ("|", len(self.b_bytes)), (",", len(self.b_bytes))) for i in range(n)]

    def ids_a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except BaseException as e:  # noqa: BLE001  its pattern gives up on some very long runs of white space by a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def ids_b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode(text), np.int64)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Aligned:
    """Some texts' tokens, groups and links, all at once: one text's bytes follow the other's."""

    def __init__(self, t: Tokenizers, raw: list[bytes]):
        a, b, length = [], [], []
        none = np.zeros(0, np.int64)
        for x in raw:
            x_a, x_b = none, none
            if x:
                text = " " + x.decode()
                x_a, x_b = t.ids_a(text), t.ids_b(text[1:])
                if not b" " + x == b"".join(map(t.a_bytes.__getitem__, x_a.tolist())) == b"".join(map(t.b_bytes.__getitem__, x_b.tolist())):
                    x_a = x_b = none
            a.append(x_a)
            b.append(x_b)
            length.append(len(x) + 1 if len(x_a) else 0)
        self.n_a, self.n_b = (np.array([len(i) for i in x], np.int64) for x in (a, b))
        ids_a, ids_b = (np.concatenate([none, *x]) for x in (a, b))
        end_a, end_b, ends = np.cumsum(t.a_size[ids_a]), np.cumsum(t.b_size[ids_b]), np.cumsum(np.array(length, np.int64))
        # between two cuts of either tokenizer lie one token of each: a link
        cuts = np.union1d(end_a, end_b)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        self.row = np.searchsorted(ends, cuts)
        self.link_a, self.link_b = ids_a[np.searchsorted(end_a, cuts)], ids_b[np.searchsorted(end_b, cuts)]
        n = len(raw)
        self.n_links, self.n_groups = np.bincount(self.row, minlength=n), np.bincount(np.searchsorted(ends, both), minlength=n)
        self.digests = self._digests(t, ids_a, ids_b, np.searchsorted(both, end_a), np.searchsorted(both, end_b))

    def _digests(self, t, ids_a, ids_b, group_a, group_b) -> list[str]:
        """SHA-256 of each text's groups. Tokens of a and b lie by group, a's first."""
        first = lambda g: np.diff(g, prepend=-1) != 0
        na, nb = len(t.a_bytes), len(t.b_bytes)
        code = np.concatenate([np.where(first(group_a), ids_a, na + ids_a), 2 * na + np.where(first(group_b), ids_b, nb + ids_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code, at, out = code[order].tolist(), 0, []
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(map(t.written.__getitem__, code[at : at + n]))[1:]).hexdigest() if n else "")
            at += n
        return out

    def postings(self) -> list[tuple]:
        """(side, ids, counts, many, rows, times) of each side id: its other ids with their counts of links here, in how many texts each is, and these
        texts with their counts."""
        key, times = np.unique((self.link_b << 48) | (self.link_a << 24) | self.row, return_counts=True)
        pair, rows = key >> 24, key & 0xFFFFFF
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        counts, many = np.add.reduceat(times, at) if len(at) else at, np.diff(at, append=len(pair))
        side, ids = pair[at] >> 24, pair[at] & 0xFFFFFF
        edge = np.append(np.flatnonzero(np.diff(side, prepend=-1)), len(side))
        cut = np.append(at, len(pair))
        return [(int(side[i]), ids[i:j], counts[i:j], many[i:j], rows[cut[i] : cut[j]], times[cut[i] : cut[j]]) for i, j in zip(edge, edge[1:])]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([*arrays, np.zeros(0, np.int64)]) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64)).cast(kind))


def _aligned(docs: DataFrame, tokenizers: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """documents (_DOCUMENT) and postings (_POSTING), stored."""
    names_d, names_p = ([x.split(" ")[0] for x in s.split(", ")] for s in (_DOCUMENT, _POSTING))

    def run(batches):
        t = worker_value(("tokenizers", tokenizers), lambda: Tokenizers(*tokenizers))
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            keys, raw = batch.column(0).to_pylist(), encoded_column(batch.column(1))
            for some in chunks([len(x) for x in raw], CHUNK):
                for at in range(some.start, some.stop, 1 << 16):
                    mine = slice(at, min(some.stop, at + (1 << 16)))
                    n = mine.stop - mine.start
                    x = Aligned(t, raw[mine])
                    chunk = part + number
                    number += 1
                    values = ([chunk] * n, range(n), keys[mine], x.n_a, x.n_b, x.n_groups, x.n_links, x.digests)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield _filled({k: pa.array(v, kind) for k, v, kind in zip(names_d, values, kinds)}, n)
                    for i in range(0, len(p := x.postings()), 4096):
                        side, ids, counts, many, rows, times = zip(*p[i : i + 4096])
                        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                        lists = [_lists(list(v), kind) for v, kind in zip((ids, counts, many, rows, times), kinds)]
                        yield _filled(dict(zip(names_p, [pa.array([chunk] * len(side)), pa.array([n] * len(side), pa.int32()), pa.array(side, pa.int32()), *lists])), len(side))

    both = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), ", ".join(dict.fromkeys([*_DOCUMENT.split(", "), *_POSTING.split(", ")])))
    kept = stored(both, "aligned")
    return kept.where("row is not null").select(*names_d), kept.where("side is not null").select(*names_p)


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of all columns of both kinds of rows, nulls where a kind has none."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names = dict(x.split(" ") for x in [*_DOCUMENT.split(", "), *_POSTING.split(", ")])
    return pa.RecordBatch.from_pydict({k: columns[k] if k in columns else pa.nulls(n, kinds[t]) for k, t in names.items()})


def pair_totals(postings: DataFrame) -> DataFrame:
    """side, id, count: links of each pair of ids in the corpus."""
    each = postings.select("side", F.explode(F.arrays_zip("ids", "counts")).alias("p"))
    return each.groupBy("side", F.col("p.ids").alias("id")).agg(F.sum("p.counts").alias("count"))


def _contributions(stream):
    """Sorted rows of totals and postings to rows (chunk, rows, n_best, count_sum) of what they add to documents, summed here for as many
    documents as are held."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    side, ids, totals, size = None, None, None, 0

    def out():
        for chunk, (best, total) in held.items():
            live = np.flatnonzero(total)
            lists = [_lists([x], kind) for x, kind in ((live, pa.int32()), (best[live], pa.int64()), (total[live], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *lists], names=["chunk", "rows", "n_best", "count_sum"])
        held.clear()

    for b in stream:
        column = {n: b.column(n) for n in b.schema.names}
        for i in range(b.num_rows):
            if column["chunk"][i].as_py() is None:
                side, ids, totals = column["side"][i].as_py(), column["ids"][i].values.to_numpy(), column["counts"][i].values.to_numpy()
                continue
            if column["side"][i].as_py() != side:
                raise ValueError("postings without their totals")
            mine, many = column["ids"][i].values.to_numpy(), column["many"][i].values.to_numpy()
            of_pair = totals[np.searchsorted(ids, mine)]
            count, best = np.repeat(of_pair, many), np.repeat(of_pair == totals.max(), many)
            rows, times = column["rows"][i].values.to_numpy(), column["times"][i].values.to_numpy().astype(np.int64)
            chunk, n = column["chunk"][i].as_py(), column["documents"][i].as_py()
            if chunk not in held:
                if size + n > HELD and held:
                    yield from out()
                    size = 0
                held[chunk] = np.zeros(n, np.int64), np.zeros(n, np.int64)
                size += n
            np.add.at(held[chunk][0], rows, times * best)
            np.add.at(held[chunk][1], rows, times * count)
    yield from out()


def _summed(key, t):
    """What all parts add to the documents of one chunk: as many entries as it has postings at most."""
    rows = np.concatenate([x.values.to_numpy() for x in t["rows"]])
    size = int(rows.max()) + 1
    sums = [np.zeros(size, np.int64) for _ in range(2)]
    for total, name in zip(sums, ("n_best", "count_sum")):
        np.add.at(total, rows, np.concatenate([x.values.to_numpy() for x in t[name]]))
    live = np.unique(rows)
    return pa.table({"chunk": pa.array(np.full(len(live), key[0].as_py())), "row": pa.array(live.astype(np.int32)), "n_best": pa.array(sums[0][live]), "count_sum": pa.array(sums[1][live])})


def tokenizer_alignment(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    A null or empty text has no tokens, nor has one that a tokenizer changes: zeros, and '' for the hash. Repeated rows count as
    often as they occur and keep their places, whatever their doc_id, which may be null. Very long texts are tokenised whole.
    Other columns are ignored; an empty table gives no rows.
    """
    documents, postings = _aligned(docs, tokenizers or default_tokenizers())
    # one row for each side id: as many as the second vocabulary has, of at most as many entries as the first
    sizes = postings.groupBy("side").agg(F.sum(F.size("rows")).alias("n")).select("side", F.ceil(F.col("n") / TOGETHER).cast("int").alias("deals"))
    lists = pair_totals(postings).groupBy("side").agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("t")).join(sizes, "side")
    totals = stored(lists.select("side", "deals", F.col("t.id").alias("ids"), F.col("t.count").alias("counts")), "totals")
    many = F.broadcast(totals.where("deals > 1").select("side", "deals"))
    dealt = postings.join(many, "side", "left").withColumn("deal", F.pmod(F.xxhash64("chunk"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    heads = totals.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    both = dealt.unionByName(heads, allowMissingColumns=True)
    # nulls come first, so a side id's totals are there before its postings
    stream = both.repartition("side", "deal").sortWithinPartitions("side", "deal", "chunk")
    added = stream.mapInArrow(releasing(_contributions), "chunk long, rows array<int>, n_best array<long>, count_sum array<long>")
    summed = added.groupBy("chunk").applyInArrow(_summed, "chunk long, row int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.join(summed, ["chunk", "row"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokenizer_alignment of the table documents: see there for nulls, odd texts and empty tables."""
    return tokenizer_alignment(table(spark, sf_dir, "documents"))


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}

"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The packer follows the linear grouping scheme. Within a shard of bounded size it sorts the large pieces,
cuts them into groups of equal cardinality and rounds each length up to its group's largest. For those
few sizes it optimises the mix of sequence configurations (a linear programme solved by column
generation), substitutes actual pieces for the rounded ones, and places what is left, largest first,
where it fits best. Shards are dealt by a hash, so that any number of documents packs in parallel;
a shard holds tens of thousands of pieces and costs at most a sequence or two more than one large run.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, encoded_column, releasing, stored, table, worker_value

#: Pieces of a shard on average.
SHARD = 1 << 16
GROUPS, LARGE_SHARE = 32, 8
#: Distinct words, and bytes of them, that a worker keeps the ids of.
CACHE, CACHE_BYTES = 700_000, 1 << 25


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens --------------------------------------------------------------------------------


class WordIds:
    """Ids of texts by a tokenizer that never merges across ASCII white space and drops it: each word is
    encoded once, then looked up by a hash, and compared. A word takes some 45 bytes, as objects it would take 200."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        """No words: sorted hashes with the words' numbers; by number the words' bytes and ids, end to end, and where each begins."""
        self.hash, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.text, self.text_at = np.zeros(8, np.uint8), np.zeros(1, np.uint32)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.uint32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has: some hundreds joined by spaces, and told apart by the places of their ids."""
        ids, lengths = [], []
        for i in range(0, len(words), 300):
            texts = [w.decode("utf-8", "surrogatepass").encode("utf-8", "replace").decode() for w in words[i : i + 300]]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ends = np.cumsum([len(t) + 1 for t in texts])
            word = np.searchsorted(ends, np.array([a for a, _ in got.offsets], np.int64), side="right")
            lengths.append(np.bincount(word, minlength=len(texts)))
            ids.append(np.array(got.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Words that are not known yet, in the order of their hashes."""
        ids, lengths = self.encode(words)
        after = lambda at, n: np.concatenate([at, at[-1] + np.cumsum(n)]).astype(np.uint32)
        place, code = np.searchsorted(self.hash, hashes), np.arange(len(self.hash), len(self.hash) + len(words))
        self.hash, self.code = np.insert(self.hash, place, hashes), np.insert(self.code, place, code)
        self.text = np.concatenate([self.text[:-8], np.frombuffer(b"".join(words) + bytes(8), np.uint8)])
        self.text_at, self.ids_at = after(self.text_at, [len(w) for w in words]), after(self.ids_at, lengths)
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, raw: list[bytes]) -> list[np.ndarray]:
        """For each text, its ids."""
        if len(self.hash) > CACHE or len(self.text) > CACHE_BYTES:
            self.clear()
        w = Words(raw)
        start, size, lanes = w.starts, w.ends - w.starts, _lanes(w.data)
        hashes, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, hashes)
        new = np.flatnonzero(np.append(self.hash, np.uint64(0))[at] != hashes)
        if len(at) > len(new) and not len(self.hash):  # a hash of 0
            new = np.arange(len(at))
        if len(new):
            self.learn(hashes[new], [w.data[i:j] for i, j in zip(start[first[new]].tolist(), w.ends[first[new]].tolist())])
            at = np.searchsorted(self.hash, hashes)
        code = self.code[at][back]
        if (self.text_at[code + 1] - self.text_at[code] == size).all() and _equal(lanes, start, _lanes(self.text), self.text_at[code].astype(np.int64), size):
            n, begin, pool = (self.ids_at[code + 1] - self.ids_at[code]).astype(np.int64), self.ids_at[code].astype(np.int64), self.ids
        else:  # two words share a hash
            pool, n = self.encode([w.data[i:j] for i, j in zip(start.tolist(), w.ends.tolist())])
            begin = np.cumsum(n) - n
        ends = np.cumsum(n)
        ids = pool[np.repeat(begin - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return np.split(ids, np.concatenate(([0], ends))[w.first[1:-1]])


def _lanes(data) -> np.ndarray:
    """Of bytes with 8 more at their end: the 8 bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> bool:
    """Whether all stretches of size bytes at a_at and b_at are equal, by the lanes of both."""
    while len(size):
        mask = np.uint64(2**64 - 1) >> (np.uint64(64) - np.minimum(size, 8).astype(np.uint64) * np.uint64(8))
        if ((a[a_at] ^ b[b_at]) & mask).any():
            return False
        more = size > 8
        a_at, b_at, size = a_at[more] + 8, b_at[more] + 8, size[more] - 8
    return True


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's ids and end_id, cut only where longer than capacity."""

    def run(batches):
        ids_of = worker_value(("words", tokenizer), lambda: WordIds(tokenizer), 0.5)
        for b in batches:
            keys, raw = b.column(0).to_pylist(), encoded_column(b.column(1))
            out = {x: [] for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for i in range(0, len(raw), 256):
                for key, ids in zip(keys[i : i + 256], ids_of(raw[i : i + 256])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), capacity):
                        part = ids[at : at + capacity]
                        for name, x in zip(out, (key, at // capacity, at, len(part), zlib.crc32(part.tobytes()))):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- packing -------------------------------------------------------------------------------


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int):
    """The most valuable multiset of sizes that fits: an unbounded knapsack, solved for one more item at a time."""
    value, took = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        best, pick = value.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            other = value[: capacity + 1 - s] + worth[g]
            better = other > best[s:] + 1e-12
            best[s:][better] = other[better]
            pick[s:][better] = g
        took.append(pick)
        if (pick < 0).all():
            break
        value = best
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(took):
        if (g := pick[room]) >= 0:
            pattern[g] += 1
            room -= sizes[g]
    return pattern, float(worth @ pattern)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400):
    """Configurations and how often to use each, at least cost for the demand: column generation with the
    revised simplex method from a start of one size for each configuration."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        pattern, value = _best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        now, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, pattern)
        grows = step > 1e-9
        if not grows.any():
            break
        ratio = np.where(grows, now / np.where(grows, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    return basis.T, np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def pack(lengths: np.ndarray, capacity: int):
    """For each piece its sequence (from 0) and place there. Equal input gives equal output."""
    n = len(lengths)
    bin_of, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    used: list[int] = []

    def put(i: int, b: int) -> None:
        bin_of[i], offset[i] = b, used[b]
        used[b] += int(lengths[i])

    full = order[lengths[order] == capacity]
    bin_of[full], used = np.arange(len(full)), [capacity] * len(full)
    rest = order[lengths[order] < capacity]
    large = rest[lengths[rest] * LARGE_SHARE > capacity]
    small = rest[lengths[rest] * LARGE_SHARE <= capacity]
    left: list[int] = []
    if len(large) >= 4 * GROUPS:
        groups = np.array_split(large, GROUPS)
        sizes = np.array([int(lengths[g[0]]) for g in groups])
        patterns, times = configurations(sizes, np.array([len(g) for g in groups]), capacity)
        queues = [list(g[::-1]) for g in groups]
        for pattern, t in zip(patterns, np.floor(times + 1e-9).astype(int)):
            for _ in range(t):
                mine = [queues[g].pop() for g in np.flatnonzero(pattern) for _ in range(int(pattern[g])) if queues[g]]
                if mine:
                    used.append(0)
                    for i in mine:
                        put(i, len(used) - 1)
        left = sorted((i for q in queues for i in q), key=lambda i: (-lengths[i], i))
    else:
        left = list(large)
    # best fit, largest first: of the sequences with room, the one with the least
    room: dict[int, list[int]] = {}
    keys: list[int] = []

    def keep(b: int) -> None:
        r = capacity - used[b]
        if r > 0:
            if r not in room:
                room[r] = []
                insort(keys, r)
            room[r].append(b)

    for b in range(len(full), len(used)):
        keep(b)
    for i in [*left, *small]:
        at = bisect_left(keys, lengths[i])
        if at < len(keys):
            r = keys[at]
            b = room[r].pop()
            if not room[r]:
                del room[r], keys[at]
        else:
            b = len(used)
            used.append(0)
        put(i, b)
        keep(b)
    return bin_of, offset


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed as often as they occur, a null doc_id
    stays null, other columns are ignored, and an empty table gives no rows. tokenizer: a file of the
    tokenizers library whose merges do not cross white space.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    shards = max(1, round(pieces.count() / SHARD))

    def run(key, t):
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        b, at = pack(t["length"].to_numpy(), capacity)
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(b + (key[0].as_py() << 32))).append_column("offset", pa.array(at))

    # with the row's place in the stored table, so that equal rows are dealt over all shards
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}

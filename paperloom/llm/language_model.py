"""Scores of documents by a gated recurrent language model with a class-factored output.

1. Documents are gathered into bundles: distinct words by hash, texts as places among them.
2. Words are counted over all training documents, dealt by hash; each bundle gets its words' counts back.
3. The most frequent words are symbols of their own, in classes of equal size. Other words fall into classes by
   the end of their spelling; words too rare to tell from unknown ones share a last class. The probability
   of a word is that of its class, given the state, times that of the word in its class: a second
   softmax for frequent words, and discounted counts for the others.
4. The network is trained by truncated backpropagation: each round goes over every training document from its
   first token to its end, in windows whose gradient stops at the window while the state is carried on.
   Partitions train apart and their weights are averaged, slice by slice, after each round.
5. A document is scored from its first token to its end, the state carried all the way.

Counts (c) are discounted by one, as if each token had been left out of them: a word's class then predicts
how often unseen and once-seen words occur, from how often words seen once or twice did.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, encoded_column, grouped, mix, parts, releasing, stored, table, text_bytes
from .spans import pack, part_of, unpack

#: Text of a bundle, in bytes.
BUNDLE = 24 << 20
HEAD, WIDTH = 512, 16  # frequent words, and how many of them make a class
ENDINGS = 95  # classes by spelling
HEAD_CLASSES = HEAD // WIDTH
RARE = HEAD_CLASSES + ENDINGS
CLASSES = RARE + 1
SYMBOLS = HEAD + ENDINGS + 2  # also the rare class and the start
START = SYMBOLS - 1
END_HASH = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Training:
    hidden: int = 24
    window: int = 24
    rounds: int = 3
    lanes: int = 64
    rate: float = 0.02


# --- bundles and counts --------------------------------------------------------------------


def _held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 10 == 0


def _bundles(batches):
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 32
    keys, hashes, endings, sizes, held = [], [], [], [], 0

    def out():
        nonlocal serial
        h, e = np.concatenate(hashes), np.concatenate(endings)
        words, at, code = np.unique(h, return_index=True, return_inverse=True)
        size = np.array(sizes, np.int64)
        valid = np.array([k is not None for k in keys], np.int8)
        ids = np.array([0 if k is None else k for k in keys], np.int64)
        aside = np.array([_held_out(k) for k in keys], np.int8)
        train = np.repeat((aside == 0), size)
        count = np.bincount(code[train], minlength=len(words)).astype(np.uint32)
        body = pack({"key": ids, "valid": valid, "aside": aside, "size": size, "word": words, "ending": e[at], "count": count, "code": code.astype(np.int32)})
        serial += 1
        return pa.RecordBatch.from_pydict({"bundle": pa.array([serial], pa.int64()), "body": pa.array([zstandard.ZstdCompressor(3).compress(body)], pa.binary())})

    for b in batches:
        ids, raw = b.column(0).to_pylist(), encoded_column(b.column(1))
        for part in chunks([len(x) for x in raw]):
            some = raw[part]
            words = Words(some, lower=True)
            h = words.hashes()
            # the class of a spelling: its last two bytes, and whether it has other than ASCII bytes
            last = words.buf[words.ends - 1].astype(np.uint64)
            before = np.where(words.ends - words.starts > 1, words.buf[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
            high = np.concatenate(([0], np.cumsum(words.buf >= 128)))
            odd = (high[words.ends] > high[words.starts]).astype(np.uint64)
            ending = (mix(last | before << np.uint64(8) | odd << np.uint64(16)) % np.uint64(ENDINGS)).astype(np.uint8)
            n = np.diff(words.first)
            stops = np.cumsum(n)
            keys += ids[part]
            hashes.append(np.insert(h, stops, END_HASH))
            endings.append(np.insert(ending, stops, 0))
            sizes += (n + 1).tolist()
            held += sum(map(len, some))
            if held >= BUNDLE:
                yield out()
                keys, hashes, endings, sizes, held = [], [], [], [], 0
    if keys:
        yield out()


def _opened(body: bytes) -> dict[str, np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(body))


def _asked(n: int):
    """A bundle's words and counts, dealt by hash."""

    def run(batches):
        for b in batches:
            for bundle, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = _opened(body)
                part = part_of(a["word"], n)
                rows = []
                for p in np.unique(part):
                    at = np.flatnonzero(part == p)
                    rows.append((int(p), bundle, pack({"word": a["word"][at], "count": a["count"][at], "ending": a["ending"][at]})))
                p, k, x = zip(*rows)
                yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "bundle": pa.array(k, pa.int64()), "body": pa.array(x, pa.binary())})

    return run


COUNTED = "bundle long, part int, body binary"


def _counted(key, t):
    """Replies to the bundles of one part, in the order of their words; and, as bundle -1, what the part adds up to."""
    bundles, all_ = t["bundle"].to_pylist(), [unpack(x) for x in t["body"].to_pylist()]
    word = np.concatenate([a["word"] for a in all_])
    words, at, back = np.unique(word, return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate([a["count"] for a in all_]).astype(np.float64), len(words)).astype(np.int64)
    ending = np.concatenate([a["ending"] for a in all_])[at]
    cuts = np.cumsum([len(a["word"]) for a in all_])[:-1]
    replies = [pack({"c": c}) for c in np.split(total[back], cuts)]
    top = np.argsort(-total, kind="stable")[:HEAD]
    known = total > 0
    body = pack({
        "sums": np.array([total.sum(), known.sum(), (total == 1).sum(), (total == 2).sum()], np.int64),
        "discounted": np.bincount(ending, np.maximum(total - 1, 0).astype(np.float64), ENDINGS),
        "top": words[top], "top_count": total[top], "top_ending": ending[top],
    })
    part = key[0].as_py()
    return pa.table({"bundle": pa.array([*bundles, -1], pa.int64()), "part": pa.array([part] * (len(bundles) + 1), pa.int32()), "body": pa.array([*replies, body], pa.binary())})


@dataclass
class Lexicon:
    """What is known of all training tokens, of fixed size: totals, frequent words, discounted sums of the classes."""

    tokens: int
    types: int
    once: int
    twice: int
    head: np.ndarray
    head_count: np.ndarray
    discounted: np.ndarray


def _lexicon(counted: DataFrame) -> Lexicon:
    def tops(batches):
        for b in batches:
            for body in b.column(0).to_pylist():
                a = unpack(body)
                yield pa.RecordBatch.from_pydict({"w": pa.array(a["top"].view(np.int64)), "c": pa.array(a["top_count"]), "e": pa.array(a["top_ending"].astype(np.int32))})

    def sums(batches):
        total = np.zeros(4 + ENDINGS)
        for b in batches:
            for body in b.column(0).to_pylist():
                a = unpack(body)
                total += np.concatenate([a["sums"].astype(float), a["discounted"]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "x": pa.array(total)})

    told = counted.where("bundle = -1").select("body")
    head = told.mapInArrow(tops, "w long, c long, e int").where("c > 2").orderBy(F.desc("c"), "w").limit(HEAD).collect()
    total = np.zeros(4 + ENDINGS)
    for r in told.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        total[r["i"]] = r["x"]
    discounted = total[4:].copy()
    for r in head:
        discounted[r["e"]] -= r["c"] - 1
    n, v, once, twice = (int(x) for x in total[:4])
    return Lexicon(n, v, once, twice, np.array([r["w"] for r in head], np.int64).view(np.uint64), np.array([r["c"] for r in head], np.int64), discounted)


PREPARED = "body binary"


def _prepared(lexicon: Lexicon, n_parts: int):
    """A bundle and its words' counts into texts of symbols, with what does not depend on the network."""

    def run(bundles, replies):
        a = _opened(bundles["body"][0].as_py())
        a["ending"] = a["ending"].astype(np.int64)
        count = np.zeros(len(a["word"]), np.int64)
        part = part_of(a["word"], n_parts)
        for p, body in zip(replies["part"].to_pylist(), replies["body"].to_pylist()):
            count[part == p] = unpack(body)["c"]
        order = np.argsort(lexicon.head)
        found = order[np.minimum(np.searchsorted(lexicon.head[order], a["word"]), max(0, len(order) - 1))] if len(order) else np.zeros(len(count), np.int64)
        is_head = lexicon.head[found] == a["word"] if len(order) else np.zeros(len(count), bool)
        symbol = np.where(is_head, found, HEAD + np.where(count >= 2, a["ending"], ENDINGS)).astype(np.uint16)
        # as if its own token were not counted: for training
        training = np.where(is_head, found, HEAD + np.where(count >= 3, a["ending"], ENDINGS)).astype(np.uint16)
        unknown = max(lexicon.once, 1) / (max(lexicon.once, 1) + 2 * lexicon.twice)
        with np.errstate(divide="ignore", invalid="ignore"):
            within = np.where(count >= 2, np.log10(np.maximum(count - 1, 1) / np.maximum(lexicon.discounted[a["ending"]], 1)), np.where(count == 1, np.log10(max(1 - unknown, 1e-9) / max(lexicon.once, 1)), np.log10(unknown)))
        within[is_head] = 0
        base = np.log10((count + 0.1) / (lexicon.tokens + 0.1 * (lexicon.types + 1)))
        first = np.concatenate(([0], np.cumsum(a["size"])))
        per_text = lambda x: np.add.reduceat(x[a["code"]], first[:-1])
        body = pack({"key": a["key"], "valid": a["valid"], "aside": a["aside"], "size": a["size"], "known": per_text((count > 0).astype(np.int64)), "base": per_text(base), "within": per_text(within), "symbol": symbol[a["code"]], "training": training[a["code"]]})
        return pa.table({"body": pa.array([zstandard.ZstdCompressor(3).compress(body)], pa.binary())})

    return run


# --- the network ---------------------------------------------------------------------------


class Network:
    """A gated recurrent unit over symbols, a softmax of classes, and one of the frequent words of a class."""

    def __init__(self, hidden: int, flat: np.ndarray | None = None):
        h = hidden
        self.hidden = h
        self.shapes = {"x": (SYMBOLS, 3 * h), "u": (h, 3 * h), "o": (h, CLASSES), "ob": (CLASSES,), "w": (HEAD_CLASSES, h, WIDTH), "wb": (HEAD_CLASSES, WIDTH)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(self.size, np.float32) if flat is None else flat.astype(np.float32).copy()
        self.p = self.views(self.flat)

    def views(self, flat):
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    @classmethod
    def fresh(cls, hidden: int, lexicon: Lexicon):
        """Small random weights, and the words' frequencies as biases."""
        net, rng = cls(hidden), np.random.default_rng(7)
        for k in ("x", "u", "o", "w"):
            net.p[k][...] = rng.normal(0, 0.1 if k == "x" else 1 / np.sqrt(hidden) / (1 if k == "u" else 4), net.shapes[k])
        head = np.full(HEAD, 0.5)
        head[: len(lexicon.head_count)] = lexicon.head_count - 1
        by_class = head.reshape(HEAD_CLASSES, WIDTH)
        mass = np.concatenate([by_class.sum(1), lexicon.discounted, [lexicon.once + 2 * lexicon.twice]])
        net.p["ob"][...] = np.log(np.maximum(mass, 0.5))
        net.p["wb"][...] = np.log(by_class)
        return net

    def step(self, x, h):
        p, k = self.p, self.hidden
        a, b = p["x"][x], h @ p["u"]
        z = 1 / (1 + np.exp(-(a[:, :k] + b[:, :k])))
        r = 1 / (1 + np.exp(-(a[:, k : 2 * k] + b[:, k : 2 * k])))
        n = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
        return n + z * (h - n), (h, z, r, n, b[:, 2 * k :])

    def log_prob(self, h, y):
        """Natural logarithm of the probability of symbols y as far as the network knows: class, and word of a frequent one."""
        logits = np.ascontiguousarray(self.p["o"].T) @ h.T
        logits += self.p["ob"][:, None]
        logits -= logits.max(0)
        cls = class_of(y)
        out = logits[cls, np.arange(len(y))]
        np.exp(logits, out=logits)
        out -= np.log(logits.sum(0))
        at = np.flatnonzero(y < HEAD)
        if len(at):
            at = at[np.argsort(cls[at].astype(np.uint8), kind="stable")]
            c, hs = cls[at], h[at].T
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True]))).tolist()
            inner = np.empty((WIDTH, len(at)), h.dtype)
            for a, b in zip(first, first[1:]):
                inner[:, a:b] = self.p["w"][c[a]].T @ hs[:, a:b]
            inner += self.p["wb"].T[:, c]
            inner -= inner.max(0)
            out[at] += inner[y[at] % WIDTH, np.arange(len(at))] - np.log(np.exp(inner).sum(0))
        return out

    def window(self, x, y, live, h):
        """Gradient of the mean negative log-probability over one window of tokens (lanes by time), and the last state.

        A lane starts anew, from a state of zeros, wherever its symbol is START; no gradient passes there."""
        p, k, g = self.p, self.hidden, np.zeros(self.size, np.float32)
        d, (lanes, steps) = self.views(g), x.shape
        x, y, live = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T).ravel(), np.ascontiguousarray(live.T)
        full, total, going = live.all(1), max(1, int(live.sum())), (x != START).astype(np.float32)
        flat = lambda v: v.transpose(1, 0, 2).reshape(v.shape[1], -1)  # noqa: E731  time by unit by lane: to unit by place
        # a sigmoid of v is (1 + tanh(v / 2)) / 2
        half = np.concatenate([np.full(2 * k, 0.5, np.float32), np.ones(k, np.float32)])
        a, ut = np.ascontiguousarray((p["x"] * half)[x].transpose(0, 2, 1)), np.ascontiguousarray((p["u"] * half).T)
        b, gates = np.empty((2, steps, 3 * k, lanes), np.float32)
        before, after = np.empty((2, steps, k, lanes), np.float32)
        h = np.ascontiguousarray(h.T)
        for t in range(steps):
            np.multiply(h, going[t], out=before[t])
            old, new, zr, n, bt, at_ = before[t], after[t], gates[t, : 2 * k], gates[t, 2 * k :], b[t], a[t]
            np.matmul(ut, old, out=bt)
            np.add(at_[: 2 * k], bt[: 2 * k], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[k:], bt[2 * k :], out=n)
            n += at_[2 * k :]
            np.tanh(n, out=n)
            np.subtract(old, n, out=new)
            new *= zr[:k]
            new += n
            if not full[t]:
                new[:, ~live[t]] = h[:, ~live[t]]
            h = new
        # the softmaxes of all places at once
        state, on = flat(after), live.ravel()
        e = np.ascontiguousarray(p["o"].T) @ state
        e += p["ob"][:, None]
        e -= e.max(0)
        np.exp(e, out=e)
        e *= on / (total * e.sum(0))
        e[class_of(y), np.arange(len(y))] -= on.astype(np.float32) / total
        np.matmul(state, e.T, out=d["o"])
        d["ob"][...] = e.sum(1)
        dh_out = p["o"] @ e
        at = np.flatnonzero(on & (y < HEAD))
        if len(at):
            at = at[np.argsort((y[at] // WIDTH).astype(np.uint8), kind="stable")]
            cls, hs, w = y[at] // WIDTH, state[:, at], p["w"]
            first = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1)).tolist()
            held = [(c, slice(first[c], first[c + 1])) for c in range(HEAD_CLASSES) if first[c] < first[c + 1]]
            f, back = np.empty((WIDTH, len(at)), np.float32), np.empty((k, len(at)), np.float32)
            for c, s in held:
                f[:, s] = w[c].T @ hs[:, s]
            f += p["wb"].T[:, cls]
            f -= f.max(0)
            np.exp(f, out=f)
            f /= f.sum(0) * total
            f[y[at] % WIDTH, np.arange(len(at))] -= np.float32(1 / total)
            for c, s in held:
                part = f[:, s]
                d["w"][c] = hs[:, s] @ part.T
                back[:, s] = w[c] @ part
            d["wb"][[c for c, _ in held]] = np.add.reduceat(f, [s.start for _, s in held], axis=1).T
            dh_out[:, at] += back
        dh_out = np.ascontiguousarray(dh_out.reshape(k, steps, lanes).transpose(1, 0, 2))
        # by the chain rule, of the gradient of a state: what passes by, and those of the candidate and the update gate;
        # and of the candidate's: those of the reset gate and of what it resets
        z, r, n = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
        of_state, of_candidate = np.empty((steps, 3, k, lanes), np.float32), np.empty((steps, 2, k, lanes), np.float32)
        one_z = 1 - z
        of_state[:, 0] = z
        np.multiply(one_z, 1 - n * n, out=of_state[:, 1])
        np.multiply((before - n) * z, one_z, out=of_state[:, 2])
        np.multiply(b[:, 2 * k :] * r, 1 - r, out=of_candidate[:, 0])
        of_candidate[:, 1] = r
        got, dh = np.empty((steps, 5, k, lanes), np.float32), np.zeros((k, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += dh_out[t]
            mine = dh if full[t] else dh * live[t]
            gt = got[t]
            np.multiply(mine, of_state[t], out=gt[:3])
            np.multiply(gt[1], of_candidate[t], out=gt[3:])
            new = p["u"] @ gt[2:].reshape(3 * k, lanes)
            new += gt[0]
            if not full[t]:
                new += dh * ~live[t]
            new *= going[t]
            dh = new
        np.matmul(flat(before), flat(got[:, 2:].reshape(steps, 3 * k, lanes)).T, out=d["u"])
        da = got[:, [2, 3, 1]].reshape(steps, 3 * k, lanes).transpose(0, 2, 1).reshape(-1, 3 * k)
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        symbols = x.ravel()[order]
        heads = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        d["x"][symbols[heads]] = np.add.reduceat(da[order], heads)
        return g, after[-1].T


def class_of(y: np.ndarray) -> np.ndarray:
    return np.where(y < HEAD, y // WIDTH, y - HEAD + HEAD_CLASSES)


def lanes_of(key: np.ndarray, size: np.ndarray, lanes: int, turn: int) -> list[np.ndarray]:
    """Deals documents to lanes of about equal numbers of tokens, each in an order of the turn; fewer documents than lanes are one each."""
    order = np.argsort(-size, kind="stable")
    held, dealt = [(0, i) for i in range(min(lanes, len(size)))], [[] for _ in range(min(lanes, len(size)))]
    for i in order.tolist():
        n, lane = held[0]
        dealt[lane].append(i)
        heapq.heapreplace(held, (n + int(size[i]), lane))
    rank = mix(key.view(np.uint64) + np.uint64(turn))
    dealt = [np.array(x, np.int64) for x in dealt]
    return [x[np.argsort(rank[x], kind="stable")] for x in dealt]


def training_windows(a: dict, lanes: int, window: int, turn: int):
    """Every token of a bundle's training documents once, as windows (symbols before, symbols, live, lanes that go on):
    a lane is whole documents one after the other, each from its first token, where the symbol before is START."""
    first = np.cumsum(a["size"]) - a["size"]
    docs = np.flatnonzero(a["aside"] == 0)
    dealt = [docs[x] for x in lanes_of(a["key"][docs], a["size"][docs], lanes, turn)]
    dealt.sort(key=lambda x: -int(a["size"][x].sum()))
    length = np.array([int(a["size"][x].sum()) for x in dealt], np.int64)
    if not len(length):
        return
    # one lane after the other, each with room for a last whole window
    room = -(-length // window) * window
    begins = np.cumsum(room) - room
    x, y = np.full(int(room.sum()), START - 1, np.uint16), np.zeros(int(room.sum()), np.uint16)
    for lane, begin, n in zip(dealt, begins.tolist(), length.tolist()):
        size = a["size"][lane]
        starts = np.cumsum(size) - size
        y[begin : begin + n] = a["training"][np.repeat(first[lane] - starts, size) + np.arange(n)]
        x[begin + 1 : begin + n] = y[begin : begin + n - 1]
        x[begin + starts] = START
    for at in range(0, int(length[0]), window):
        on = int(np.searchsorted(-length, -at))  # the longest lanes are first
        place = begins[:on, None] + np.arange(at, at + window)
        yield x[place].astype(np.int64), y[place].astype(np.int64), np.arange(at, at + window) < length[:on, None], on


def _trained(flat: np.ndarray, how: Training, turn: int, slices: int):
    """Trains on a partition's documents, each from its first token to its end; gives the weights' sums by slice."""

    def run(batches):
        net = Network(how.hidden, flat)
        square, seen, tokens = np.full(net.size, 1e-6, np.float32), 0, 0
        rate, work = np.float32(how.rate / (1 + 0.5 * turn) * 0.3), np.empty(net.size, np.float32)
        for b in batches:
            for body in b.column(0).to_pylist():
                h, most = np.zeros((how.lanes, how.hidden), np.float32), None
                for x, y, live, on in training_windows(_opened(body), how.lanes, how.window, turn):
                    g, h = net.window(x, y, live, h[:on])
                    n = int(live.sum())
                    most = most or n
                    if n < most:  # lanes have ended: each token weighs as before
                        g *= np.float32(n / most)
                    np.clip(g, -1, 1, out=g)
                    np.multiply(g, g, out=work)
                    work *= np.float32(0.02)
                    square *= np.float32(0.98)
                    square += work
                    seen, tokens = seen + 1, tokens + n
                    np.multiply(square, np.float32(1 / (1 - 0.98 ** min(seen, 1000))), out=work)
                    np.sqrt(work, out=work)
                    work += np.float32(1e-4)
                    g /= work
                    g *= rate
                    net.flat -= g
        if seen:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "n": pa.array([tokens] * slices, pa.int64()), "w": pa.array([x.tobytes() for x in np.array_split(net.flat.astype(np.float64) * tokens, slices)], pa.binary())})

    return run


def _added(key, t):
    total = sum(np.frombuffer(x, np.float64) for x in t["w"].to_pylist())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})


def train(prepared: DataFrame, lexicon: Lexicon, how: Training) -> np.ndarray:
    net, slices = Network.fresh(how.hidden, lexicon), 8
    for turn in range(how.rounds):
        kind = "slice int, n long, w binary"
        each = prepared.mapInArrow(releasing(_trained(net.flat, how, turn, slices)), kind).withColumn("g", F.pmod(F.xxhash64("w"), F.lit(32)).cast("int"))
        got = each.groupBy("slice", "g").applyInArrow(_added, kind).groupBy("slice").applyInArrow(_added, kind).collect()
        if got:
            net = Network(how.hidden, np.concatenate([np.frombuffer(r["w"], np.float64) / r["n"] for r in sorted(got, key=lambda r: r["slice"])]))
    return net.flat


def _scored(flat: np.ndarray, hidden: int, train_tokens: int):
    def run(batches):
        net = Network(hidden, flat)
        for b in batches:
            for body in b.column(0).to_pylist():
                a = _opened(body)
                order = np.argsort(-a["size"], kind="stable")
                size, first = a["size"][order], (np.cumsum(a["size"]) - a["size"])[order]
                h, x = np.zeros((len(order), hidden), np.float32), np.full(len(order), START, np.int64)
                score = np.zeros(len(order))
                for t in range(int(size.max(initial=0))):
                    live = int(np.searchsorted(-size, -t))  # of the texts, longest first, those with a token t
                    h, _ = net.step(x[:live], h[:live])
                    x = a["symbol"][first[:live] + t].astype(np.int64)
                    score[:live] += net.log_prob(h, x)
                total = np.empty(len(order))
                total[order] = score / np.log(10)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(a["key"], mask=a["valid"] == 0), "held_out": pa.array(a["aside"] == 1), "n_tokens": pa.array(a["size"]), "n_known": pa.array(a["known"]),
                    "train_tokens": pa.array(np.full(len(order), train_tokens)), "base_score": pa.array(a["base"]), "score": pa.array(total + a["within"]),
                })

    return run


def score_documents(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Scores are log10 probabilities of the whole text, its end included. Documents whose crc32(doc_id) mod 10 is 0 are
    held out of all that is learned; a null doc_id counts as the text "None". A null or empty text is its end
    alone. Repeated rows count as often as they occur; other columns are ignored; an empty table gives no rows.
    """
    n = parts(docs.sparkSession, text_bytes(docs))
    bundles = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(_bundles), "bundle long, body binary"), "bundles")
    asked = bundles.mapInArrow(releasing(_asked(n)), "part int, bundle long, body binary")
    counted = stored(grouped(asked, n, "part").applyInArrow(_counted, COUNTED), "counts")
    lexicon = _lexicon(counted)
    replies = counted.where("bundle >= 0")
    prepared = stored(bundles.groupBy("bundle").cogroup(replies.groupBy("bundle")).applyInArrow(_prepared(lexicon, n), PREPARED), "prepared")
    flat = train(prepared, lexicon, how)
    return prepared.mapInArrow(releasing(_scored(flat, how.hidden, lexicon.tokens)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_scores": op3_lm_scores}

"""A byte-level convolutional network for the quality of documents, in numpy.

A text's bytes are cut into overlapping chunks, so that every byte and every pair of neighbours is seen within
one; filters slide over a chunk's embedded bytes, and each leaves its largest response there, from which a hidden layer makes
the chunk's features. Over a document's chunks the largest and the mean of each feature are combined into one
probability. A document of any length is scored whole, some chunks at a time.

Labels are learnt from a bounded sample of documents, which are whole as well: see Training.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded_column, releasing, stored, table

#: The symbol that fills the end of a chunk.
PAD = 256


@dataclass(frozen=True)
class Training:
    """rows, nbytes: bounds of the sample that labels are learnt from, labelled documents by a hash of their ids until
    either is reached. steps: updates at least; epochs: passes over the sample at least. balance: the power of the ratio of the labels'
    counts by which a document of the rarer label counts more."""

    rows: int = 6000
    nbytes: int = 16 << 20
    steps: int = 500
    epochs: int = 3
    batch: int = 32
    rate: float = 0.004
    balance: float = 0.75
    seed: int = 11


@dataclass(frozen=True)
class Shape:
    """Bytes of a chunk and how many it shares with the next; filters, their width and step; sizes of the embedding and the hidden layer.
    Of a text of a chunk or more the last chunk ends where the text does, so that only shorter texts are filled up."""

    chunk: int = 192
    overlap: int = 32
    filters: int = 48
    width: int = 8
    step: int = 2
    embedding: int = 8
    hidden: int = 24


class Network:
    def __init__(self, shape: Shape, seed: int):
        rng, s = np.random.default_rng(seed), shape
        normal = lambda *size, scale: (rng.standard_normal(size) * scale).astype(np.float32)
        self.shape = shape
        self.p = {
            "e": normal(257, s.embedding, scale=0.5), "w": normal(s.width * s.embedding, s.filters, scale=(2 / (s.width * s.embedding)) ** 0.5), "b": np.zeros(s.filters, np.float32),
            "u": normal(s.filters, s.hidden, scale=(1 / s.filters) ** 0.5), "c": np.zeros(s.hidden, np.float32), "v": normal(2 * s.hidden, 1, scale=s.hidden**-0.5), "d": np.zeros(1, np.float32),
        }

    def chunks(self, raw: bytes) -> np.ndarray:
        """Rows of a chunk's bytes each; of an empty text, one row of PAD."""
        s = self.shape
        stride = s.chunk - s.overlap
        symbols = np.full(max(len(raw), s.chunk), PAD, np.int16)
        symbols[: len(raw)] = np.frombuffer(raw, np.uint8)
        at = np.append(np.arange(0, len(symbols) - s.chunk, stride), len(symbols) - s.chunk)
        return np.lib.stride_tricks.sliding_window_view(symbols, s.chunk)[at]

    def patches(self, symbols: np.ndarray) -> np.ndarray:
        """Embedded bytes under each place of a filter: (chunks, places, width * embedding)."""
        s = self.shape
        x = self.p["e"][symbols]
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, s.width, axis=1)[:, :: s.step].transpose(0, 1, 3, 2)).reshape(len(x), -1, s.width * s.embedding)

    def pooled(self, symbols: np.ndarray, places: bool = False):
        """Each filter's largest response in each chunk, not under zero; with places, also where it is."""
        x = self.patches(symbols)
        r = (x.reshape(-1, x.shape[2]) @ self.p["w"]).reshape(len(x), x.shape[1], -1)
        top = np.maximum(r.max(axis=1) + self.p["b"], 0)
        return (top, r.argmax(axis=1)) if places else top

    def features(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top @ self.p["u"] + self.p["c"], 0)

    def probability(self, large: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([large, mean], axis=1) @ self.p["v"] + self.p["d"]
        return 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))

    def score(self, texts: list[bytes], block: int = 512) -> np.ndarray:
        """The probability of each text. Chunks of all texts go through the filters some at a time; a text keeps only its largest and its
        sum so far."""
        f = self.shape.hidden
        top, total, count = np.zeros((len(texts), f), np.float32), np.zeros((len(texts), f), np.float64), np.zeros(len(texts))
        waiting: list[tuple[int, np.ndarray]] = []

        def through():
            symbols, owner = np.concatenate([c for _, c in waiting]), np.repeat([i for i, _ in waiting], [len(c) for _, c in waiting])
            got = self.features(self.pooled(symbols))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            at = owner[first]
            top[at] = np.maximum(top[at], np.maximum.reduceat(got, first))
            total[at] += np.add.reduceat(got, first, dtype=np.float64)
            waiting.clear()

        room = block
        for i, raw in enumerate(texts):
            cut = self.chunks(raw)
            count[i] = len(cut)
            while len(cut):
                waiting.append((i, cut[:room]))
                cut, room = cut[room:], room - len(cut[:room])
                if room == 0:
                    through()
                    room = block
        if waiting:
            through()
        return self.probability(top, (total / np.maximum(count, 1)[:, None]).astype(np.float32))

    def gradient(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray | float = 1.0):
        """Mean weighted cross entropy over some documents, and its gradient. Of a chunk only the places of the largest responses take part."""
        s, p = self.shape, self.p
        cut = [self.chunks(t) for t in texts]
        owner, n = np.repeat(np.arange(len(cut)), [len(c) for c in cut]), np.array([len(c) for c in cut])
        symbols = np.concatenate(cut)
        top, at = (np.concatenate(x) for x in zip(*[self.pooled(symbols[i : i + 512], True) for i in range(0, len(symbols), 512)]))
        first = np.cumsum(n) - n
        h = self.features(top)
        large, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]
        y = self.probability(large, mean)
        loss = float(-np.mean(weights * np.where(labels, np.log(y + 1e-7), np.log(1 - y + 1e-7))))
        dz = (weights * (y - labels) / len(texts)).astype(np.float32)[:, None]
        g = {"v": np.concatenate([large, mean], axis=1).T @ dz, "d": dz.sum(0)}
        dx = dz @ p["v"].T
        # the largest over chunks goes to the first chunk that has it, the mean to all
        k = np.arange(len(owner))[:, None]
        winner = np.minimum.reduceat(np.where(h == large[owner], k, len(owner)), first)
        dh = (dx[:, s.hidden :] / n[:, None])[owner]
        np.add.at(dh, (winner, np.arange(s.hidden)[None, :]), dx[:, : s.hidden])
        dh *= h > 0
        g |= {"u": top.T @ dh, "c": dh.sum(0)}
        dtop = (dh @ p["u"].T) * (top > 0)
        g["b"] = dtop.sum(0)
        w, e = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        start, lanes = at * s.step, np.arange(s.width)
        for f in range(s.filters):
            live = np.flatnonzero(dtop[:, f])
            seen = symbols[live[:, None], start[live, f][:, None] + lanes]
            d = dtop[live, f][:, None]
            w[:, f] = (p["e"][seen].reshape(len(live), -1) * d).sum(0)
            np.add.at(e, seen, d[:, :, None] * p["w"][:, f].reshape(1, s.width, s.embedding))
        return loss, g | {"w": w, "e": e}


def trained(texts: list[bytes], labels: np.ndarray, training: Training, shape: Shape = Shape()) -> Network:
    """A network fitted by Adam, in batches of documents of like length, which come in another order each time. Equal input gives equal output."""
    net, rng = Network(shape, training.seed), np.random.default_rng(training.seed)
    share = min(max(float(labels.mean()), 0.01), 0.99) if len(labels) else 0.5
    rare = (max(share, 1 - share) / min(share, 1 - share)) ** training.balance
    weights = np.where(labels == (share < 0.5), rare, 1.0)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    by_length = np.argsort([len(t) for t in texts], kind="stable")
    batches = [by_length[i : i + training.batch] for i in range(0, len(texts), training.batch)]
    passes = max(training.epochs, -(-training.steps // max(1, len(batches)))) if batches else 0
    t, last = 0, passes * len(batches)
    for _ in range(passes):
        mixed = by_length[np.argsort(np.array([len(texts[i]) for i in by_length]) * rng.uniform(0.7, 1.4, len(texts)), kind="stable")]
        for b in rng.permutation(len(batches)):
            some = mixed[b * training.batch : (b + 1) * training.batch]
            _, g = net.gradient([texts[i] for i in some], labels[some], weights[some])
            t += 1
            rate = training.rate * (1 - t / (last + 1)) * min(1, t / 20)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(key: Column, of: int = 5) -> Column:
    """Whether a key's CRC-32 is divisible by `of`; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % of == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, training: Training) -> DataFrame:
    """quality, text of the documents to learn from: whole texts, equal rows once. Both bounds hold however often an id occurs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")  # other columns may have names that are used here
    marked = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.rows)
    sized = docs.where("text is not null").join(F.broadcast(few), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    keys = sized.groupBy("doc_id", "quality", "h").agg(F.first("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(training.rows).toPandas()
    keys = keys[(keys["n"].cumsum() <= training.nbytes)]
    wanted = docs.sparkSession.createDataFrame([(int(a), int(q), int(h)) for a, q, h in zip(keys["doc_id"], keys["quality"], keys["h"])], "doc_id long, quality int, h long")
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(wanted), ["doc_id", "h"])
    return found.groupBy("doc_id", "h", "quality").agg(F.first("text").alias("text")).select("doc_id", "quality", "text")


def quality_scores(docs: DataFrame, labels: DataFrame, training: Training = Training(), shape: Shape = Shape(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text), learnt from labels (doc_id, quality 0 or 1).

    A null text is an empty one, which has a score as others do. Rows with a null or repeated doc_id keep their places; a null one is not held out.
    Labels that are neither 0 nor 1 and labels without a document are left out; of several for a document the higher counts. Without any,
    scores are those of an untrained network. A very long text is scored whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        net = trained(encoded_column(t["text"]), t["quality"].to_numpy().astype(bool), training, shape)
        return pa.table({"network": pa.array([pickle.dumps(net.p)], pa.binary())})

    # the sample is bounded, so one task learns from it; its weights, some tens of kilobytes, go to all
    got = stored(sample(docs, labels, training).withColumn("one", F.lit(1)), "sample").groupBy("one").applyInArrow(fit, "network binary").first()
    weights = got and bytes(got["network"])

    def run(batches):
        net = Network(shape, training.seed)
        if weights:
            net.p = pickle.loads(weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(encoded_column(b.column(1))).astype(np.float64))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_scores of the table documents by the table labels: see there for nulls, repeated rows and empty tables."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_byte_convolution": op12_byte_convolution}

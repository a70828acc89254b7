"""Packed rows that carry arrays between stages, and spans of documents brought back to their texts.

A stage hands on rows (kind, part, body): arrays of one kind for one destination, packed, in place of a
row for each element. `part` is a hash of what must meet; how many parts there are follows from the bytes of
text (common.parts), so that a part stays small whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import bloom_has, bounded_bloom, encoded_column, grouped, mix, released, releasing

PACKED = "kind int, part int, body binary"
SPANS = 1  # the kind of spans to remove; other kinds are a stage's own


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    head = ",".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values())


def unpack(body: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    out, at = {}, 4 + n
    for item in body[4:at].decode().split(","):
        name, kind, size = item.split(":")
        out[name] = np.frombuffer(body, kind, int(size), at)
        at += out[name].nbytes
    return out


def unpacked(bodies) -> dict[str, np.ndarray]:
    """The arrays of several rows, joined."""
    all_ = [unpack(x) for x in bodies]
    return {k: np.concatenate([x[k] for x in all_]) for k in all_[0]} if all_ else {}


def dealt(kind: int, part: np.ndarray, arrays: dict[str, np.ndarray]):
    """Rows (kind, part, body) of the arrays' elements by part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, b in zip(edge, [*edge[1:], len(part)]):
        yield kind, int(part[a]), pack({k: v[a:b] for k, v in arrays.items()})


def batch(rows) -> pa.RecordBatch:
    kind, part, body = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "body": pa.array(body, pa.binary())})


def part_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x.view(np.uint64) if x.dtype == np.int64 else x) % np.uint64(n)).astype(np.int32)


def spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n: int):
    """Rows of spans [start, end) of documents. Spans that touch, in the order given, become one."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate(end + _shift(doc, end))
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] + _shift(doc, end)[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    yield from dealt(SPANS, part_of(doc[at], n), {"doc": doc[at], "start": start[at].astype(np.int32), "end": (reach - _shift(doc, end))[last].astype(np.int32)})


def _shift(doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """An offset for each row that sets documents apart on one axis."""
    return (np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))) * (int(end.max()) + 2)


def ids_of(rows: DataFrame) -> DataFrame:
    """doc_id of what packed rows with an array `doc` name; repeats possible."""

    def run(batches):
        for b in batches:
            ids = [np.unique(unpack(x)["doc"]) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))})

    return rows.select("body").mapInArrow(run, "doc_id long").distinct()


def chosen(docs: DataFrame, bloom: bytes, n: int) -> DataFrame:
    """part, doc_id, text and any other columns of the documents that a Bloom filter of ids lets through. docs starts
    with doc_id and text."""

    def run(batches):
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            keep = bloom_has(bloom, ids) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            part = pa.array(part_of(ids[keep], n), pa.int32())
            yield pa.RecordBatch.from_arrays([part, *(x.filter(pa.array(keep)) for x in b.columns)], names=["part", *b.schema.names])

    return docs.mapInArrow(releasing(run), StructType([StructField("part", IntegerType()), *docs.schema.fields]))


def without_spans(docs: DataFrame, found: DataFrame, n: int, finish, schema: str) -> DataFrame:
    """For each row of docs (key, text, more columns): the other columns, and finish(text bytes, starts, ends) as
    columns of schema. found: packed rows of spans, by key, in n parts. Only texts that have spans are shuffled to
    them; a row with a null key has none."""
    found = found.where(F.col("kind") == SPANS)
    bloom = bounded_bloom(ids_of(found), "doc_id")
    key, _, *more = docs.columns
    fields, none = StructType.fromDDL(schema).fields, np.zeros(0, np.int64)
    types = {"bigint": pa.int64(), "string": pa.string()}
    kinds = [types[f.dataType.simpleString()] for f in fields]
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(f"carried{i}") for i, c in enumerate(more)])
    kind = StructType([*docs.schema.fields[2:], *fields])
    table = lambda rows, carried: pa.RecordBatch.from_arrays([*carried, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=kind.names)

    def clean(batches):
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            rest = pa.array(~(bloom_has(bloom, ids) & b.column(0).is_valid().to_numpy(zero_copy_only=False)))
            yield table([finish(x, none, none) for x in encoded_column(b.column(1).filter(rest))], [x.filter(rest) for x in b.columns[2:]])

    def cut(texts, rows):
        a = unpacked(rows["body"].to_pylist())
        where = {}
        if a:
            order = np.lexsort((a["start"], a["doc"]))
            a = {k: v[order] for k, v in a.items()}
            ids, first = np.unique(a["doc"], return_index=True)
            where = {int(k): (x, y) for k, x, y in zip(ids, first, [*first[1:], len(order)])}
        out = []
        for k, x in zip(texts["doc_id"].to_pylist(), encoded_column(texts["text"].combine_chunks())):
            i, j = where.get(k, (0, 0))
            out.append(finish(x, a["start"][i:j].astype(np.int64) if a else none, a["end"][i:j].astype(np.int64) if a else none))
        return released(pa.Table.from_batches([table(out, [texts[f"carried{i}"].combine_chunks() for i in range(len(more))])]))

    untouched = docs.mapInArrow(releasing(clean), kind)
    touched = grouped(chosen(docs, bloom, n), n, "part").cogroup(grouped(found, n, "part")).applyInArrow(cut, kind)
    return untouched.unionByName(touched).select(*[F.col(f"carried{i}").alias(c) for i, c in enumerate(more)], *[f.name for f in fields])


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(ends, n), -1)
    return np.cumsum(step[:-1]) > 0

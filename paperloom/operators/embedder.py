"""Vectors of texts by a model that takes batches, loaded once in each Python worker."""

from __future__ import annotations

import logging
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

#: Texts that a model gets at once.
BATCH = 32


def _model(name: str, load: Callable):
    held = sys.modules.setdefault("_paperloom_models", types.ModuleType("_paperloom_models")).__dict__
    if name not in held:
        held[name] = load()
    return held[name]


def embedded(texts: DataFrame, keys: list[str], load: Callable[[], Callable[[list[str]], np.ndarray]], name: str, batch: int = BATCH, isolate: bool = False) -> DataFrame:
    """keys, embedding (array<float>) of texts (keys, text). load: gives the model, a function of a list of texts to an array with a row for each;
    workers keep it under its name for later tasks. Each call but the last of a partition has `batch` texts, whatever batches Arrow makes. A null text has
    a null vector, and the model does not see it. isolate: where the model raises on a batch, it gets the batch's texts one by one, and those it raises
    on have null vectors; else its error ends the job."""
    kind = StructType([*[StructField(k, texts.schema[k].dataType) for k in keys], StructField("embedding", ArrayType(FloatType()))])

    def vectors_of(model, said: list[str]) -> np.ndarray:
        got = np.asarray(model(said), np.float32)
        if len(got) != len(said):
            raise ValueError(f"the model gave {len(got)} vectors for {len(said)} texts")
        return got

    def one_by_one(model, said: list[str]) -> list:
        found: list = []
        for x in said:
            try:
                found.append(vectors_of(model, [x])[0])
            except Exception:  # noqa: BLE001 - any text may be one that the model can't take
                logging.getLogger("paperloom").warning("a text of %d characters has no vector", len(x), exc_info=True)
                found.append(None)
        return found

    def run(batches):
        model, held, waiting = _model(name, load), [], 0

        def out(n: int):
            nonlocal held, waiting
            t = pa.Table.from_batches(held).combine_chunks()
            some, rest = t.slice(0, n), t.slice(n)
            held, waiting = rest.to_batches(), len(rest)
            said = some["text"].to_pylist()
            there = [i for i, x in enumerate(said) if x is not None]
            vectors: list = [None] * len(said)
            if there:
                texts_there = [said[i] for i in there]
                try:
                    got = vectors_of(model, texts_there)
                except Exception:
                    if not isolate:
                        raise
                    got = one_by_one(model, texts_there)
                for i, v in zip(there, got):
                    vectors[i] = v
            columns = [some[k].combine_chunks() for k in keys]
            return pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*keys, "embedding"])

        for b in batches:
            held.append(b)
            waiting += b.num_rows
            while waiting >= batch:
                yield out(batch)
        if waiting:
            yield out(waiting)

    return texts.select(*keys, "text").mapInArrow(run, kind)

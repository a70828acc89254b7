"""The queries of this subpackage and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, bpe, convolution, html, jaccard, language_model, merkle, packing, pii, quality, substrings, suffixes, topk

MODULES = (bpe, html, jaccard, language_model, packing, pii, quality, substrings, suffixes, topk, alignment, convolution, merkle)


def queries() -> dict:
    found = {}
    for m in MODULES:
        found |= m.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    found = {}
    for m in MODULES:
        found |= getattr(m, "ORACLES", {})
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

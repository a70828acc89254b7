"""Anchors of windows: which windows of fixed length can be equal, told from a few of their places.

A window's anchor is the place of its least seed (a shorter window) by hash, the leftmost on ties, so that
equal windows have equal anchors at the same offset. Windows of one text that follow each other and share
an anchor form a segment; equal windows lie in segments of equal anchor hash. Segments are few, about
2 / (window - seed + 2) of all places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols, from sums of symbol * P ** place."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power = np.full(n, _P, np.uint64)
        if n:
            power[0] = 1
            power = np.multiply.accumulate(power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * power, out=self.sums[1:])
        del power
        self.back = np.full(n + 1, _P_INVERSE, np.uint64)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Hash of each stretch of this length."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (van Herk's two passes over blocks of w)."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


@dataclass
class Segments:
    """For each segment: hash of its anchor, hash of all its symbols, its text, and the first and the count of
    its windows' places in the whole sequence."""

    anchor: np.ndarray
    body: np.ndarray
    text: np.ndarray
    lo: np.ndarray
    n: np.ndarray


def segments(symbols: np.ndarray, first: np.ndarray, seed: int, window: int) -> tuple[Segments, Rolling]:
    """Segments of texts laid end to end; text i is symbols[first[i]:first[i + 1]]."""
    rolling = Rolling(symbols)
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none), rolling
    bits = np.uint64(max(1, int(len(symbols)).bit_length()))
    place = np.arange(len(symbols) - seed + 1, dtype=np.uint64)
    least = sliding_min((rolling.every(seed) >> bits << bits) | place, window - seed + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths)
    # windows that cross the end of a text are none
    good = np.zeros(len(at), bool)
    ends = first[1:][text[: len(at)]]
    good = np.arange(len(at)) + window <= ends
    change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (good[1:] != good[:-1]) | (text[1 : len(at)] != text[: len(at) - 1]))))
    stop = np.append(change[1:], len(at))
    keep = good[change]
    lo, hi = change[keep], stop[keep]
    anchor = at[lo]
    hashes = mix(rolling(anchor, anchor + seed))
    body = mix(rolling(lo, hi - 1 + window) ^ (anchor - lo).astype(np.uint64) * np.uint64(_P) + (hi - lo).astype(np.uint64))
    return Segments(hashes, body, text[lo], lo, hi - lo), rolling

"""Cutting a sequence into the stretches of windows that share their least gram.

Every window of `size` units has a least gram (by hash, the leftmost of equals), which is at the same place in every equal window. Consecutive windows with one least gram form a stretch: equal windows always lie in stretches with equal gram hashes, so only stretches with a repeated gram can hold repeated windows. Stretches partition the windows of a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mix64


def doubled_grams(h: np.ndarray, doublings: int) -> np.ndarray:
    """Hashes of all runs of 2 ** doublings units."""
    step = 1
    with np.errstate(over="ignore"):
        for _ in range(doublings):
            if len(h) <= step:
                return np.zeros(0, np.uint64)
            a, b = h[:-step], h[step:]
            h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(29)) ^ (b * np.uint64(0xD1B54A32D192ED03) + np.uint64(step))
            h ^= h >> np.uint64(32)
            step *= 2
    return mix64(h)


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of size elements."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(units: np.ndarray, size: int, doublings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first window, number of windows and the gram's place of each stretch."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    g = doubled_grams(units, doublings)
    bits = np.uint64(max(8, int(len(g)).bit_length()))
    place = np.arange(len(g), dtype=np.uint64)
    least = sliding_least((g >> bits << bits) | place, size - (1 << doublings) + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[first]], first, np.diff(first, append=n), at[first]


def digest64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def marks_by_doc(marks: DataFrame) -> DataFrame:
    """Marks (doc_id, start, m), m windows from start on, as two arrays a document."""
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "m")).alias("marks")).select("doc_id", F.col("marks.start").alias("starts"), F.col("marks.m").alias("lengths"))


def covered(n: int, size: int, starts, lengths) -> np.ndarray:
    """Which of n units the marked windows cover."""
    change = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        s = np.asarray(starts)
        np.add.at(change, s, 1)
        np.add.at(change, s + np.asarray(lengths) + size - 1, -1)
    return np.cumsum(change[:-1]) > 0

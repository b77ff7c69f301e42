"""Longest common subsequence of two texts, the one measure Spark has no built-in for."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers inside the task, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS (Hyyrö 2004): one big-integer step per character of the longer text."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


#: Classes of characters whose counts are compared before two texts are.
CLASSES = 64


def class_counts(texts: list[str]) -> np.ndarray:
    """How often each class of characters occurs in each text."""
    out = np.zeros((len(texts), CLASSES), np.int16)
    for row, text in zip(out, texts):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        row += np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=CLASSES).astype(np.int16)
    return out


def best_pairs(left: list[str], right: list[str] | None, floor: float, top: int) -> list[tuple[str, str, float]]:
    """The ``top`` most similar pairs of a text of ``left`` and one of ``right`` (of two of ``left`` if that is None)
    from ``floor`` up, by similarity and then by value.

    Insertions and deletions between two texts are at least the differences of their character counts, which rules most
    pairs out in numpy; once ``top`` pairs are known, only better ones are scored.
    """
    own = right is None
    right = left if own else right
    a, b = class_counts(left), class_counts(right)
    occurs = a.any(axis=0) | b.any(axis=0)
    a, b = a[:, occurs], b[:, occurs]
    len_a, len_b = (np.array([len(t) for t in x]) for x in (left, right))
    found: list[tuple[float, str, str]] = []
    for i, x in enumerate(left):
        start = i + 1 if own else 0
        both = len_a[i] + len_b[start:]
        apart = np.abs(b[start:] - a[i]).sum(axis=1)
        for j in np.flatnonzero(apart <= (1 - floor) * both + 1e-9) + start:
            similar = 2.0 * lcs_length(x, right[j]) / (len_a[i] + len_b[j])
            if similar >= floor - 1e-9 and x != right[j]:
                found.append((-similar, min(x, right[j]), max(x, right[j])))
        if len(found) > 4 * top:
            found = sorted(set(found))[:top]
            floor = max(floor, -found[-1][0])
    return [(x, y, -s) for s, x, y in sorted(set(found))[:top]]

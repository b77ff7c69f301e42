"""Co-moments of many numeric columns in one scan: a state of fixed shape that merges exactly and stably."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tablecheck.functions import columns as C

# Ship this module inside the task, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that merge the states of all others before the last one does.
MERGERS = 16


class CoMoments:
    """For each pair of columns (i, j), over the rows in which neither is missing: ``n``, ``mean`` and ``spread`` (sum of
    squared deviations) of column i, ``cross`` (sum of products of deviations), and whether an infinite value took part."""

    def __init__(self, size: int):
        self.n, self.mean, self.spread, self.cross, self.infinite = np.zeros((5, size, size))

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """State of a block of rows (rows × columns, NaN is missing)."""
        state = cls(x.shape[1])
        there = ~np.isnan(x)
        endless = np.isinf(x)
        some = np.where(there & ~endless, x, 0.0)
        count = np.maximum((there & ~endless).sum(axis=0), 1)
        apart = np.where(there & ~endless, np.abs(some - some.sum(axis=0) / count), np.inf)
        # deviations from a value of the column near its mean: small, and exactly 0 in a constant column
        at = apart.argmin(axis=0)
        shift = some[at, np.arange(x.shape[1])]
        d, m = np.where(there & ~endless, x - shift, 0.0), there.astype(np.float64)
        state.n = m.T @ m
        n = np.maximum(state.n, 1.0)
        total = d.T @ m
        state.mean = total / n + shift[:, None]
        state.spread = np.maximum((d * d).T @ m - total * total / n, 0.0)
        state.cross = d.T @ d - total * total.T / n
        state.infinite = endless.astype(np.float64).T @ m
        return state

    def merge(self, other: CoMoments) -> CoMoments:
        """Both together, by the updating formulas of Chan, Golub and LeVeque."""
        n = self.n + other.n
        share = other.n / np.maximum(n, 1.0)
        far = np.where(self.n > 0, np.where(other.n > 0, other.mean - self.mean, 0.0), 0.0)
        out = CoMoments(len(n))
        out.n, out.infinite = n, self.infinite + other.infinite
        out.mean = np.where(self.n > 0, self.mean + far * share, other.mean)
        out.spread = self.spread + other.spread + far * far * self.n * share
        out.cross = self.cross + other.cross + far * far.T * self.n * share
        return out

    def correlation(self) -> np.ndarray:
        """Pearson's r of each pair; NaN without two rows, without spread, or with an infinite value."""
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.clip(self.cross / (np.sqrt(self.spread) * np.sqrt(self.spread.T)), -1.0, 1.0)
        r[(self.n < 2) | (self.infinite > 0) | (self.infinite.T > 0) | (self.spread <= 0) | (self.spread.T <= 0)] = np.nan
        same = np.arange(len(r))
        r[same, same] = np.where(np.isnan(r[same, same]), np.nan, 1.0)
        return r

    def packed(self) -> bytes:
        return np.stack([self.n, self.mean, self.spread, self.cross, self.infinite]).tobytes()

    @classmethod
    def unpacked(cls, body: bytes, size: int) -> CoMoments:
        state = cls(size)
        state.n, state.mean, state.spread, state.cross, state.infinite = np.frombuffer(body).reshape(5, size, size)
        return state


def co_moments(df: DataFrame, columns: list[str]) -> CoMoments:
    """Of numeric columns; null and NaN are missing. One scan whatever the number of columns: every task folds its rows
    into one state, a few tasks fold those, one folds the last. What comes to the driver depends on the columns alone."""
    size = len(columns)
    df = C.normalise_missing(df)
    cells = df.select(*[C.as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])

    def fold(states: Iterator[CoMoments]) -> Iterator[pa.RecordBatch]:
        whole = CoMoments(size)
        for state in states:
            whole = whole.merge(state)
        yield pa.record_batch([pa.array([whole.packed()], pa.binary())], names=["state"])

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = (np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1) for b in stream if b.num_rows)
        return fold(map(CoMoments.of, values))

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(CoMoments.unpacked(v.as_py(), size) for b in stream for v in b.column("state"))

    states = cells.mapInArrow(count, "state binary").repartition(MERGERS).mapInArrow(join, "state binary")
    whole = CoMoments(size)
    for row in states.collect():  # one for each merging task
        whole = whole.merge(CoMoments.unpacked(bytes(row["state"]), size))
    return whole

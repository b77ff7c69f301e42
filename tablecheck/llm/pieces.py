"""Encode texts piece by piece: pieces that a tokenizer never merges across are encoded once per worker."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Pieces remembered per worker before the memory is emptied; a bound on memory without effect on results.
REMEMBERED = 400_000


def tokenizer_path(name: str) -> str:
    """An absolute path as it is; else the file of that name among the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(texts: pa.Array, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], whole: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut texts (null: empty) into pieces: the distinct ones, the number of each piece among these in the order of the
    texts, and how many pieces each text has.

    ``cuts`` gets the UTF-8 bytes of all texts together, and behind each byte the one that follows it in its text (a
    space at the end of a text), and tells before which bytes to cut; texts are cut from each other anyway. Texts marked
    in ``whole`` are one piece each.
    """
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    follow = np.append(body[1:], np.uint8(32))[: len(body)]
    follow[edges[edges > 0] - 1] = 32
    marks = np.append(cuts(body, follow), True)
    for k in np.flatnonzero(whole) if whole is not None else ():
        marks[edges[k] : edges[k + 1]] = False
    marks[edges] = True
    at = np.flatnonzero(marks)
    pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)).dictionary_encode()
    return pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(), np.diff(np.searchsorted(at, edges))


class PieceStore:
    """Ids of pieces in one flat array, looked up by numbers that pieces get when first met; the new ones of a batch are
    encoded together. ``encode`` gives for a list of pieces their ids in one array, for each piece where its ids start
    and how many they are, and its flags (bits; zero for nothing to tell)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.starts, self.sizes, self.flags = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def ids(self, distinct: list[str], places: np.ndarray, pieces: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, cut by :func:`cut_pieces`, with ``end`` after each; the number of ids of each text, and the
        flags of its pieces together. A batch is never split by the limit."""
        if max(len(self.numbers), len(self.flat) // 8) > self.limit:
            self._forget()
        old = len(self.starts)
        met = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        fresh = [distinct[k] for k in np.flatnonzero(met >= old)]  # in the order of their numbers
        if fresh:
            ids, starts, sizes, flags = self.encode(fresh)
            self.starts, self.sizes = np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.sizes, sizes])
            self.flat, self.flags = np.concatenate([self.flat, ids]), np.concatenate([self.flags, flags])
        met = met[places]
        sizes, last = self.sizes[met], np.cumsum(pieces)
        stops = np.cumsum(sizes)
        shift = np.repeat(self.starts[met] - stops + sizes, sizes)
        shift += np.arange(len(shift))
        out, ends = self.flat[shift], np.append(0, stops)[last]
        lengths, told = np.diff(ends, prepend=0), np.zeros(len(pieces), np.uint8)
        flagged = np.flatnonzero(self.flags[met])
        np.bitwise_or.at(told, np.searchsorted(last, flagged, side="right"), self.flags[met[flagged]])
        if end is not None:
            out, lengths = np.insert(out, ends, np.uint32(end)), lengths + 1
        return out, lengths, told

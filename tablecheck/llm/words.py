"""Words of many texts at once, as numpy arrays. White space is space and U+0009 to U+000D."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: list[str | None], lower=bytes.lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each word, its length, number of words of each text).

    ``lower`` works on the UTF-8 bytes; bytes.lower changes A-Z only. Null is empty. Texts are joined by a line break.
    """
    raw = [b"" if t is None else lower(t.encode()) for t in texts]
    body = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    blank = BLANK[body]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))  # of each text's line break
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends, side="left")]))
    return body, start, stop - start, counts


def hash_words(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: a polynomial in random odd byte values, mixed. Two of n words collide with a chance of about n * n / 2**65."""
    global _power
    if not len(start):
        return np.zeros(0, np.uint64)
    longest = int(length.max())
    if longest > len(_power):
        _power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * longest, _BASE)]), dtype=np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    values = _BYTE[body[place + np.repeat(start, length)]] * _power[place]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the A-Z lower-cased words of all texts in order, words per text)."""
    body, start, length, counts = split_words(texts)
    return hash_words(body, start, length), counts

"""Fill-in-the-middle documents: cuts between word units, found through a Fenwick tree over blocks of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.words import BLANK

#: Bytes of a block of text, and of text cut at a time (one text at least).
BLOCK_BYTES, BATCH_BYTES = 512, 4_000_000
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


class Fenwick:
    """Counts per block under two heads, units and code points, as trees of partial sums."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        node = np.arange(len(units) + 1)
        low = node & -node
        sums = np.zeros((2, len(units) + 1), np.int64)
        np.cumsum(units, out=sums[0, 1:])
        np.cumsum(points, out=sums[1, 1:])
        self.tree = sums - sums[:, node - low]
        self.top = 1 << (len(units).bit_length() - 1) if len(units) else 0

    def before(self, block: np.ndarray) -> np.ndarray:
        """(units, code points) of all blocks before each block."""
        total, node = np.zeros((2, len(block)), np.int64), block.copy()
        while node.any():
            total += self.tree[:, node]
            node &= node - 1
        return total

    def descend(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block that holds the rank-th unit's end, units before that block, code points before it), ranks from 1, by binary lifting."""
        block, total, step = np.zeros(len(rank), np.int64), np.zeros((2, len(rank)), np.int64), self.top
        while step:
            ahead = block + step
            inside = ahead < self.tree.shape[1]
            more = self.tree[:, np.where(inside, ahead, 0)]
            go = inside & (total[0] + more[0] < rank)
            block, total = np.where(go, ahead, block), np.where(go, total + more, total)
            step >>= 1
        return block, total[0], total[1]


def cut_texts(raw: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text ``raw[bounds[i] : bounds[i + 1]]`` (UTF-8): its n units, and the code points before and between the cuts
    after first % (n + 1) and second % (n + 1) units, the lesser one first."""
    blank = BLANK[raw]
    closes = np.ones(len(raw), bool)  # a blank or the end of the text follows
    closes[:-1] = blank[1:]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    closes[last] = True
    ends = closes & ~blank
    ends[last] = True  # blanks at the end are a unit of their own
    leads = (raw & 0xC0) != 0x80
    blocks = -(-len(raw) // BLOCK_BYTES) + 1
    shaped = np.zeros((2, blocks * BLOCK_BYTES), bool)
    shaped[0, : len(raw)], shaped[1, : len(raw)] = ends, leads
    shaped = shaped.reshape(2, blocks, BLOCK_BYTES)
    tree = Fenwick(*shaped.sum(axis=2, dtype=np.int64))

    block, inside = bounds // BLOCK_BYTES, bounds % BLOCK_BYTES
    here = np.arange(BLOCK_BYTES)[None, :] < inside[:, None]
    base = tree.before(block) + np.stack([(s[block] & here).sum(axis=1) for s in shaped])
    n = np.diff(base[0])
    cuts = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)

    def points(rank: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(rank), np.int64), np.flatnonzero(rank)
        block, units, chars = tree.descend(base[0, :-1][some] + rank[some])
        within = np.cumsum(shaped[0, block], axis=1, dtype=np.int16)
        at = (within == (base[0, :-1][some] + rank[some] - units)[:, None]).argmax(axis=1)
        local = (shaped[1, block] & (np.arange(BLOCK_BYTES)[None, :] <= at[:, None])).sum(axis=1)
        out[some] = chars + local - base[1, :-1][some]
        return out

    prefix, through = points(cuts[0]), points(cuts[1])
    return n, prefix, through - prefix


@F.arrow_udf(CUTS)
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    whole = text.cast(pa.large_binary()).fill_null(b"")
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    body = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    h = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (first, second)]
    out, start = [np.zeros((3, 0), np.int64)], 0
    while start < len(whole):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_BYTES, side="right")) - 1)
        bounds = offsets[start : stop + 1]
        out.append(np.stack(cut_texts(body[bounds[0] : bounds[-1]], bounds - bounds[0], h[0][start:stop], h[1][start:stop])))
        start = stop
    n, prefix, middle = np.concatenate(out, axis=1)
    return pa.StructArray.from_arrays([pa.array(n), pa.array(prefix), pa.array(middle)], names=["n", "prefix_chars", "middle_chars"])


def fill_in_middle(docs: DataFrame, percent: int = 50, suffix_first: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (any type), ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` of every whole text, one row per row.

    A text is cut into n units: white space with the word behind it, and white space at the end. The hash of ``seed`` and the id
    decides: ``percent`` of the texts are cut into prefix, middle and suffix after two numbers of units, ``suffix_first`` percent
    of those written as ``<S>suffix<P>prefix<M>middle`` (spm), the rest as ``<P>prefix<S>suffix<M>middle`` (psm). Others,
    empty texts and texts that hold a mark stay as they are (plain; no figures of characters). So the same id has the same
    cuts in every run, wherever its row lies, and rows that repeat an id draw alike.

    Null text counts as empty; a null id is hashed as if it were empty. White space alone is one unit. Empty tables give an
    empty result; other columns are ignored. Only the text goes to Python, only three numbers come back; nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("cuts", _cuts("text", group(0), group(1)))
    plain = (F.col("text") == "") | (group(2) % 100 >= percent)
    for mark in MARKS:
        plain = plain | F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(group(3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", F.col("cuts.n").alias("n"), form.alias("form"), F.col("cuts.prefix_chars").alias("p"), F.col("cuts.middle_chars").alias("m"))
    p, m = F.col("p").cast("int"), F.col("m").cast("int")
    prefix, middle = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    suffix = F.substring("text", p + m + 1, F.char_length("text"))
    spm = F.concat(F.lit(MARKS[1]), suffix, F.lit(MARKS[0]), prefix, F.lit(MARKS[2]), middle)
    psm = F.concat(F.lit(MARKS[0]), prefix, F.lit(MARKS[1]), suffix, F.lit(MARKS[2]), middle)
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("p")).alias("prefix_chars"), F.when(cut, F.col("m")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone. Null where either is."""
    part = lambda k: F.get(F.split(output, "|".join(MARKS), -1), F.lit(k))
    spm, psm = F.concat(part(2), part(3), part(1)), F.concat(part(1), part(3), part(2))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)

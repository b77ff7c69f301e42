"""Token ids on disk: frequency ranks in 1 to 4 bytes, lengths in separate control bytes, decoded by table lookup."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecheck.llm.pieces import PieceStore, cut_pieces, tokenizer_path
from tablecheck.sources.storage import scratch_path

#: Ids in a block of a file, about; a document is never cut.
BLOCK_IDS = 262_144
#: Texts encoded together, in characters.
BATCH_CHARS = 4_000_000
#: Lengths of the four values that a control byte describes: two bits each, lowest first, length less one.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) & 3) + 1).astype(np.uint8)

TOKEN_SCHEMA = "part int, block int, doc_ids array<bigint>, lengths array<int>, ids binary, seen array<int>, times array<bigint>"
FILE_SCHEMA = "part int, block int, doc_ids array<bigint>, lengths array<int>, control binary, data binary"
READ_SCHEMA = "part int, block int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of values below 2**32: each in as few bytes as it needs, low byte first."""
    values = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    control = (padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: the table gives all lengths, their running sum the place of every value."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    values = raw[at]
    for byte in (1, 2, 3):
        longer = size > byte
        values[longer] |= raw[at[longer] + byte] << np.uint32(8 * byte)
    return values


#: The tokenizer's own splitter always cuts before a space or line break that something else than white space follows,
#: behind such a line break, and between a letter and another ASCII character, so pieces cut there are encoded one by one.
#: ``_FOLLOWS``: bytes that begin no white space, nor a character that engines disagree to call so (lead bytes of
#: U+0080-00BF, U+1000-3FFF and U+F000-FFFF, and control characters).
_LETTERS, _FOLLOWS, _SIGNS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FOLLOWS[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] = True
_SIGNS[0x21:0x7F] = ~_LETTERS[0x21:0x7F]
_WORD = re.compile(r" \S+").fullmatch
#: Pieces remembered per worker, and pieces encoded as one string.
REMEMBERED, JOINED = 1_000_000, 512


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceStore:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the byte-level sign of a space
    none = np.zeros(0, np.int64)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # a space and a word: strings of them are cut again where a token begins with the space
        words = [k for k, p in enumerate(pieces) if _WORD(p)]
        strings = ["".join([pieces[k] for k in words[i : i + JOINED]]) for i in range(0, len(words), JOINED)]
        ids = np.concatenate([none, *[e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]])
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        edges = np.flatnonzero(begins[ids])
        starts[words], sizes[words] = edges, np.diff(np.append(edges, len(ids)))
        rest = np.setdiff1d(np.arange(len(pieces)), words)
        others = [e.ids for e in tokenizer.encode_batch_fast([pieces[k] for k in rest.tolist()], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in others]
        starts[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
        return np.concatenate([ids, *others]).astype(np.uint32), starts, sizes, np.zeros(len(pieces), np.uint8)

    table = PieceStore(encode, REMEMBERED)
    # special tokens are searched in the whole text, so texts that hold one are encoded whole
    table.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return table


def cuts(body: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Before which bytes pieces begin: see ``_FOLLOWS``."""
    led = ((body == 32) | (body == 10)) & _FOLLOWS[follow]
    behind = led & (body == 10) | _LETTERS[body] & _SIGNS[follow]
    led[1:] |= behind[:-1]
    return led


def encode_batch(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null: empty), one after the other and each with the end id, and how many each text has."""
    table = _encoder(path)
    special = [pa.compute.fill_null(pa.compute.match_substring(texts, s), False).to_numpy(zero_copy_only=False) for s in table.special]
    ids, sizes, _ = table.ids(*cut_pieces(texts, cuts, np.any(special, axis=0) if special else None), end_id)
    return ids, sizes


def encode_texts(texts: list[str], path: str, end_id: int | None) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, with the end id."""
    ids, sizes = encode_batch(pa.array(texts, pa.string()), path, end_id)
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def batches(stream: Iterator[pa.RecordBatch], text: str, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``chars`` bytes of text, one row at least."""
    for batch in stream:
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            used = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, used + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _tokenise(path: str, end_id: int):
    """Blocks of encoded documents, and at the end of the task one row with the counts of all its ids."""
    names = ["part", "block", "doc_ids", "lengths", "ids", "seen", "times"]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def row(*values) -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_here, part, block = tokenizer_path(path), TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0
        total = np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            raw = np.concatenate(ids)
            width = "<u2" if raw.max(initial=0) < 65536 else "<u4"
            body = bytes([2 if width == "<u2" else 4]) + raw.astype(width).tobytes()
            return row(part, block, np.concatenate(docs), np.concatenate(sizes), body, None, None)

        for batch in batches(stream, "text"):
            got, lengths = encode_batch(batch.column("text"), path_here, end_id)
            some = np.bincount(got, minlength=len(total))
            some[: len(total)] += total
            total = some
            of, stops, start = batch.column("id"), np.cumsum(lengths), 0
            while start < len(lengths):  # documents up to the one that fills the block
                before = int(stops[start - 1]) if start else 0
                stop = min(len(lengths), int(np.searchsorted(stops, before + BLOCK_IDS - held)) + 1)
                docs.append(of.slice(start, stop - start).to_numpy(zero_copy_only=False) if not of.null_count else np.array(of.slice(start, stop - start).to_pylist(), object))
                sizes.append(lengths[start:stop].astype(np.int32))
                ids.append(got[before : int(stops[stop - 1])])
                held, start = held + int(stops[stop - 1]) - before, stop
                if held >= BLOCK_IDS:
                    yield out()
                    docs, sizes, ids, held, block = [], [], [], 0, block + 1
        if docs:
            yield out()
        seen = np.flatnonzero(total)
        if len(seen):
            yield row(None, None, None, None, None, seen.astype(np.int32), total[seen])

    return run


def _raw_ids(body: bytes) -> np.ndarray:
    return np.frombuffer(body, "<u2" if body[0] == 2 else "<u4", offset=1)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every whole text and write the ids under ``path``: ``path/ranks`` (rank, id) and ``path/blocks``.

    Documents are in ascending order of id (null ids first, repeated ids by text): part after part, block after
    block. A block holds the ids of its documents, their lengths and, for all their tokens, the frequency ranks as
    control bytes and data bytes. Null text counts as empty and has the end id alone; a text of any length lies in
    one block; an empty table gives files without blocks. Other columns are ignored.

    Texts are range-sorted and encoded once into a written table, which also holds the counts of each task; ranks come
    from the sums of these (one row per id of the vocabulary comes back), and a second pass over it writes the files.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    raw = scratch_path(spark, "tokens")
    ordered.mapInArrow(_tokenise(tokenizer, end_id), TOKEN_SCHEMA).write.option("compression", "zstd").parquet(raw)
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(raw)
    tokens = rows.where("part is not null").drop("seen", "times")
    counted = rows.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).select(F.col("x.seen").alias("id"), F.col("x.times").alias("n"))
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    ids = [r["id"] for r in counts.select("id").collect()]
    rank = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank[np.array(ids, np.int64)] = np.arange(len(ids), dtype=np.uint32)
    ranks = spark.createDataFrame([(r, i) for r, i in enumerate(ids)], "rank bigint, id bigint")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")

    def recode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            packed = [pack(rank[_raw_ids(b.as_py())]) for b in batch.column("ids")]
            columns = [batch.column(c) for c in ("part", "block", "doc_ids", "lengths")]
            yield pa.record_batch([*columns, pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())], names=["part", "block", "doc_ids", "lengths", "control", "data"])

    tokens.mapInArrow(recode, FILE_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the decoded ids as little-endian 32-bit integers)."""
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                size = np.array(row["lengths"], np.int64)
                stop = np.cumsum(size)
                values = ids[unpack(row["control"], row["data"], int(stop[-1]))]
                crc = [zlib.crc32(values[b - n : b].tobytes()) for b, n in zip(stop, size, strict=True)]
                n = len(size)
                yield pa.record_batch([pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(stop - size, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = totals.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("block_start")).join(parts, "part")
    read = blocks.mapInArrow(decode, READ_SCHEMA).join(starts, ["part", "block"])
    return read.select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

"""Katz back-off language model: Good-Turing discounted bigram counts, exactly normalised back-off weights."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise
from tablecheck.llm.token_files import batches
from tablecheck.llm.words import mix, word_hashes
from tablecheck.sources.storage import scratch_path

#: Hashes of the end of a text, which is a token, and of its beginning, which is a history only.
END, START = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Text of a chunk in bytes, and entries of a partition of the count tables, about.
CHUNK_BYTES, PART_ENTRIES = 12_000_000, 1_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5

CHUNKS = "chunk bigint, doc_ids array<bigint>, tokens array<bigint>, train array<boolean>, words binary, sequence binary"
ASKED = "part int, chunk bigint, keys binary, numbers binary"
ANSWERED = "chunk bigint, kind string, part int, body binary, total bigint, kinds bigint, ranks array<bigint>"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal place side by side: the empty high ones all but vanish in a compressed shuffle."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(body: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def sized(values: np.ndarray) -> bytes:
    """Whole numbers in one, two, four or eight bytes each."""
    most = int(values.max(initial=0))
    size = 1 if most < 2**8 else 2 if most < 2**16 else 4 if most < 2**32 else 8
    return bytes([size]) + planes(values.astype(f"<u{size}"))


def from_sized(body: bytes) -> np.ndarray:
    return from_planes(body[1:], f"<u{body[0]}").astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a key: ascending keys have ascending partitions."""
    return (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def discounts(ranks: list[int]) -> np.ndarray:
    """Good-Turing factors of the counts 1 to k from the numbers of bigrams seen 1 to k + 1 times. Where these numbers
    give none between 0 and 1, half a count is taken off."""
    k = len(ranks) - 1
    out = []
    for r in range(1, k + 1):
        top = (k + 1) * ranks[k] / ranks[0] if ranks[0] else 1.0
        d = ((r + 1) * ranks[r] / (r * ranks[r - 1]) - top) / (1 - top) if ranks[r - 1] and top < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


class Chunk:
    """Some documents as numbers of their distinct words; every text ends with the end token."""

    def __init__(self, row):
        self.id, self.doc_ids = int(row["chunk"]), row["doc_ids"]
        self.tokens = np.asarray(row["tokens"], np.int64)
        self.train = np.asarray(row["train"], bool)
        self.words = np.frombuffer(row["words"], "<u8")
        self.sequence = from_sized(row["sequence"])

    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.tokens)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.sequence[self.trained()], minlength=len(self.words))

    def histories(self) -> np.ndarray:
        """Hashes of what may stand before a token: the words, then the beginning."""
        return np.append(self.words, START)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams in order of their keys: (key, history, word), and the place of each token's bigram among them."""
        before = np.concatenate([[0], self.sequence[:-1]])
        before[np.cumsum(self.tokens) - self.tokens] = len(self.words)
        code, place = np.unique(before * len(self.words) + self.sequence, return_inverse=True)
        history, word = code // len(self.words), code % len(self.words)
        keys = mix(self.histories()[history] * np.uint64(0xD6E8FEB86659FD93) + self.words[word])
        order = np.argsort(keys, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return keys[order], history[order], word[order], back[place]


def _chunks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches(stream, "text", CHUNK_BYTES):
        hashes, counts = word_hashes(batch.column("text").to_pylist())
        sequence = np.insert(hashes, np.cumsum(counts), END)
        words, place = np.unique(sequence, return_inverse=True)
        columns = [pa.array([number], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([(counts + 1).tolist()], pa.list_(pa.int64())), pa.array([batch.column("train").to_pylist()], pa.list_(pa.bool_())), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([sized(place)], pa.binary())]
        yield pa.record_batch(columns, names=["chunk", "doc_ids", "tokens", "train", "words", "sequence"])
        number += 1


def _ask(chunk: int, keys: np.ndarray, numbers: list[np.ndarray], parts: int) -> Iterator[dict]:
    """Rows for the partitions of a count table: ascending keys as differences, and numbers for each."""
    place = part_of(keys, parts)
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        steps = np.diff(keys[a:b], prepend=np.uint64(0))
        yield {"part": int(place[a]), "chunk": chunk, "keys": planes(steps), "numbers": b"".join(len(x).to_bytes(4, "little") + x for x in (sized(n[a:b]) for n in numbers))}


def _asker(kind: str, parts: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                if kind == "words":
                    rows = list(_ask(chunk.id, chunk.words, [chunk.word_counts()], parts))
                else:
                    keys, _, _, place = chunk.pairs()
                    rows = list(_ask(chunk.id, keys, [np.bincount(place[chunk.trained()], minlength=len(keys))], parts))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())]))

    return run


def _read_asked(pdf: pd.DataFrame) -> tuple[list[int], list[int], np.ndarray, list[np.ndarray]]:
    """(chunks, entries of each, all keys, each number of all entries)."""
    pdf = pdf.sort_values("chunk")
    keys = [np.cumsum(from_planes(b, "<u8"), dtype=np.uint64) for b in pdf["keys"]]
    numbers = []
    for body in pdf["numbers"]:
        fields = []
        while body:
            n = int.from_bytes(body[:4], "little")
            fields.append(from_sized(body[4 : 4 + n]))
            body = body[4 + n :]
        numbers.append(fields)
    return pdf["chunk"].tolist(), [len(k) for k in keys], np.concatenate(keys), [np.concatenate(x) for x in zip(*numbers, strict=True)]


def _answers(kind: str, part: int, chunks: list[int], sizes: list[int], bodies: list[bytes], total: int = 0, kinds: int = 0, ranks: list[int] | None = None) -> pd.DataFrame:
    """One row for each asking chunk, and one (chunk -1) with the figures of the whole partition."""
    rows = [(c, kind, part, b, 0, 0, None) for c, b in zip(chunks, bodies, strict=True)]
    return pd.DataFrame([*rows, (-1, kind, part, None, total, kinds, ranks)], columns=["chunk", "kind", "part", "body", "total", "kinds", "ranks"])


def _totaller(kind: str):
    """A partition of a count table: the total of every key over all chunks. The answer to a chunk has, for each key asked
    for, twice its total, plus one if the chunk is the first to have counted it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks, sizes, keys, (counts,) = _read_asked(pdf)
        unique, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts, len(unique)).astype(np.int64)
        counted = np.flatnonzero(counts > 0)[::-1]
        first = np.full(len(unique), -1)
        first[place[counted]] = counted
        owned = np.zeros(len(keys), np.int64)
        owned[first[first >= 0]] = 1
        value = np.split(2 * total[place] + owned, np.cumsum(sizes)[:-1])
        ranks = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        return _answers(kind, int(pdf["part"].iloc[0]), chunks, sizes, [sized(v) for v in value], int(total.sum()), int((total > 0).sum()), ranks.tolist())

    return run


def _answer(messages: pd.DataFrame, kind: str) -> np.ndarray:
    bodies = messages[messages["kind"] == kind].sort_values("part")["body"]
    return np.concatenate([from_sized(b) for b in bodies])


def _history_sums(parts: int):
    """What a chunk knows of its histories: over the bigrams it was the first to count, the sum of their counts, the
    sum of (count + 1) of their words, and how many were seen 1, 2, ... times."""

    def run(left: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in left.iterrows():
            chunk = Chunk(row)
            word_count, pair = _answer(messages, "words") >> 1, _answer(messages, "pairs")
            _, history, word, _ = chunk.pairs()
            mine = (pair & 1) == 1
            history, seen, word = history[mine], (pair >> 1)[mine], word[mine]
            n = len(chunk.words) + 1
            sums = [np.bincount(history, seen, n), np.bincount(history, word_count[word] + 1, n), *[np.bincount(history[seen == r], minlength=n) for r in range(1, DISCOUNTED + 1)]]
            hashes = chunk.histories()
            order = np.argsort(hashes, kind="stable")
            rows += _ask(chunk.id, hashes[order], [s[order].astype(np.int64) for s in sums], parts)
        return pd.DataFrame(rows, columns=["part", "chunk", "keys", "numbers"])

    return run


def back_off(total: np.ndarray, word_mass: np.ndarray, seen: list[np.ndarray], factors: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, back-off weight) of histories, so that discounted and backed-off probabilities sum to one.

    ``word_mass``: sum of (count + 1) over the words seen behind the history. A history none of whose counts is
    discounted has a denominator greater by one, so that something is left for other words; an unseen one backs off fully.
    """
    taken = sum((r * s * (1 - d) for r, (s, d) in enumerate(zip(seen, factors, strict=True), 1)), np.zeros(len(total)))
    denominator = np.where(taken > 0, total, total + 1).astype(float)
    left = 1 - (total - taken) / denominator
    weight = left / (1 - word_mass / (tokens + kinds + 1))
    return denominator, np.where(total > 0, weight, 1.0)


def _history_answers(factors: np.ndarray, tokens: int, kinds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks, sizes, keys, numbers = _read_asked(pdf)
        unique, place = np.unique(keys, return_inverse=True)
        total, mass, *seen = [np.bincount(place, x, len(unique)) for x in numbers]
        denominator, weight = back_off(total, mass, seen, factors, tokens, kinds)
        both = np.stack([np.log10(denominator), np.log10(weight)])[:, place]
        ends = np.cumsum(sizes)
        return _answers("histories", int(pdf["part"].iloc[0]), chunks, sizes, [planes(both[:, e - s : e].ravel()) for e, s in zip(ends, sizes, strict=True)])

    return run


def _scorer(factors: np.ndarray, tokens: int, kinds: int):
    def run(left: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            chunk = Chunk(row)
            word_count, count = _answer(messages, "words") >> 1, _answer(messages, "pairs") >> 1
            _, history, word, place = chunk.pairs()
            found = [from_planes(b, "<f8").reshape(2, -1) for b in messages[messages["kind"] == "histories"].sort_values("part")["body"]]
            order = np.argsort(chunk.histories(), kind="stable")
            denominator, weight = np.empty((2, len(order)))
            denominator[order], weight[order] = np.concatenate(found, axis=1)
            base = np.log10((word_count + 1) / (tokens + kinds + 1))
            factor = np.append(np.append(1.0, factors), 1.0)[np.minimum(count, DISCOUNTED + 1)]
            seen = np.log10(np.maximum(factor * count, 1e-300)) - denominator[history]
            pair_score = np.where(count > 0, seen, weight[history] + base[word])
            doc = np.repeat(np.arange(len(chunk.tokens)), chunk.tokens)
            add = lambda x: np.bincount(doc, x, len(chunk.tokens))  # noqa: B023, E731
            out.append(pd.DataFrame({
                "doc_id": pd.array(list(chunk.doc_ids), "Int64"), "held_out": ~chunk.train, "n_tokens": chunk.tokens, "n_known": add(word_count[chunk.sequence] > 0).astype(np.int64),
                "train_tokens": tokens, "base_score": add(base[chunk.sequence]), "score": add(pair_score[place]),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])

    return run


def katz_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows for which the condition ``train`` holds, and score all whole texts.

    Tokens are A-Z lower-cased words between ASCII white space, then the end. P(w | h) is d(c) c / n(h) for a bigram
    seen c times (d: Good-Turing factor, below 1 up to a count of 5), else a(h) P(w), with P(w) = (count of w + 1) /
    (N + V + 1): one step of the recursion, per token. a(h) makes each distribution sum to one over the known
    words and one unknown. Result: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens`` (N), ``base_score`` and ``score`` (log10 of the products of P(w) and of P(w | h)). One row per row.
    Null text counts as empty and has the end token alone; a null condition counts as held out; repeated rows and null
    ids are rows like others. With nothing to learn from every token has probability 1. Other columns are ignored.

    Texts are read once, into chunks of numbered words. Count tables are partitioned by a hash of the n-gram, so a
    common word or pair is spread no worse than others: each chunk asks for it once. Chunks and partitions exchange
    packed arrays; a partition sums the counts of all chunks and answers each in the order it asked. Words and
    bigrams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    name, width = f"katz_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = rows.mapInArrow(_chunks, CHUNKS)
    # bucketed, so that the two passes which bring answers to chunks leave the chunks where they are
    chunked.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd").bucketBy(width, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    entries = chunks.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, math.ceil(entries / PART_ENTRIES))
    few = max(1, math.ceil(parts / 4))  # for words: far fewer are distinct

    def answered(kind: str, parts: int) -> DataFrame:
        return materialise(chunks.mapInArrow(_asker(kind, parts), ASKED).groupBy("part").applyInPandas(_totaller(kind), ANSWERED), kind)

    words, pairs = answered("words", few), answered("pairs", parts)
    tokens, kinds = words.filter("chunk = -1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ranks = pairs.filter("chunk = -1").agg(*[F.coalesce(F.sum(F.col("ranks")[i]), F.lit(0)) for i in range(DISCOUNTED + 1)]).first()
    factors = discounts(list(ranks))

    def told(*tables: DataFrame) -> DataFrame:
        out = None
        for t in tables:
            t = t.filter("chunk >= 0").select("chunk", "kind", "part", "body")
            out = t if out is None else out.unionByName(t)
        return out.groupBy("chunk")

    asked = chunks.groupBy("chunk").cogroup(told(words, pairs)).applyInPandas(_history_sums(few), ASKED)
    histories = materialise(asked.groupBy("part").applyInPandas(_history_answers(factors, tokens, kinds), ANSWERED), "histories")
    return chunks.groupBy("chunk").cogroup(told(words, pairs, histories)).applyInPandas(_scorer(factors, tokens, kinds), SCORED)

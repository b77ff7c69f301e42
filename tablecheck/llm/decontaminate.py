"""Passages of test items in documents: Wu-Manber search over normalised text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise
from tablecheck.llm.token_files import batches
from tablecheck.llm.words import mix

#: Words of a window.
WINDOW = 10
#: Windows that begin in one piece of an item; longer items are several pieces.
PIECE_WINDOWS = 1000
#: Item text searched for in one pass over the documents, in bytes: what a task holds grows with this, not with the items.
PASS_BYTES = 4 << 20
#: Text searched at a time, and places that one cursor walks over, in bytes.
BATCH_BYTES, SEGMENT = 4_000_000, 1024
#: Longest block of the shift table, suffix that selects test strings, and head of a pattern that the tables look at, in bytes.
BLOCK, SUFFIX, HEAD = 8, 24, 64

#: Fixed value: a word is a run of these, A-Z lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def normalised(raw: bytes) -> bytes:
    """The words of a text, each between single blanks: " a b "; empty without words."""
    words = raw.translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def eight(body: np.ndarray, at: np.ndarray, count: int = 8) -> np.ndarray:
    """``count`` bytes from each place as one number."""
    out = np.zeros((len(at), 8), np.uint8)
    out[:, :count] = body[at[:, None] + np.arange(count)]
    return out.view("<u8")[:, 0]


class WuManber:
    """Byte patterns searched together. ``body`` holds them at ``start``, each ``length`` bytes long.

    Only the first m bytes of each pattern (m: the shortest length, at most HEAD) enter the tables. ``shift`` tells by the
    last block of m bytes of text how far the end of those m bytes may move without passing over a pattern; where it says 0,
    the hash of their suffix selects the patterns that are then compared byte by byte.
    """

    def __init__(self, body: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.m = m = min(int(length.min()), HEAD)
        self.block, self.suffix = max(1, min(BLOCK, m // 2)), min(m, SUFFIX)
        self.body, self.start, self.length = np.concatenate([body, np.zeros(8, np.uint8)]), start, length
        self.bits = np.uint64(64 - min(22, max(10, (len(start) * m).bit_length() + 1)))
        self.shift = np.full(1 << int(64 - int(self.bits)), m - self.block + 1, np.int16)
        for end in range(self.block, m + 1):  # later blocks allow less, and overwrite
            self.shift[self._slot(body, start + end - self.block)] = m - end
        key = self._suffix_key(body, start + m - self.suffix)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.first, self.count = np.unique(key[self.order], return_index=True, return_counts=True)

    def _slot(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (mix(eight(body, at, self.block)) >> self.bits).astype(np.int64)

    def _suffix_key(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for off in range(0, self.suffix, 8):
            key = mix(key ^ eight(body, at + off, min(8, self.suffix - off)))
        return key

    def search(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the pattern) of every occurrence. Each segment of the text has its own cursor; all move together."""
        end = np.arange(self.m, len(body) + 1, SEGMENT)
        stop = np.minimum(end + SEGMENT, len(body) + 1)
        padded = np.concatenate([body, np.zeros(8, np.uint8)])
        places, patterns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(end):
            jump = self.shift[self._slot(body, end - self.block)]
            stay = jump == 0
            if stay.any():
                at, which = self._confirm(padded, len(body), end[stay] - self.m)
                places.append(at)
                patterns.append(which)
            end = end + np.maximum(jump, 1)
            going = end < stop
            end, stop = end[going], stop[going]
        return np.concatenate(places), np.concatenate(patterns)

    def _confirm(self, text: np.ndarray, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self._suffix_key(text, at + self.m - self.suffix)
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[slot] == key
        at, slot = at[same], slot[same]
        several = self.count[slot]
        inside = np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
        at, which = np.repeat(at, several), self.order[np.repeat(self.first[slot], several) + inside]
        fits = at + self.length[which] <= size
        at, which = at[fits], which[fits]
        done_at, done, off = [], [], 0
        while len(at):  # eight bytes further each time, with those still equal
            left = np.minimum(self.length[which] - off, 8)
            mask = _LOW_BYTES[left]
            equal = (eight(text, at + off) & mask) == (eight(self.body, self.start[which] + off) & mask)
            over = equal & (self.length[which] <= off + 8)
            done_at.append(at[over])
            done.append(which[over])
            going = equal & ~over
            at, which, off = at[going], which[going], off + 8
        return np.concatenate([*done_at, np.zeros(0, np.int64)]), np.concatenate([*done, np.zeros(0, np.int64)])


class TestStrings:
    """The distinct windows of some pieces of items, in classes of like length, each with its tables."""

    __test__ = False  # not a test case

    def __init__(self, pieces: list[tuple[str | None, str]], words: int):
        """pieces: (item id, words with single blanks between)."""
        self.names = sorted({name for name, _ in pieces if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        windows: dict[bytes, set[int]] = {}
        for name, text in pieces:
            parts = text.encode().split(b" ")
            for i in range(max(1, len(parts) - words + 1)):
                owners = windows.setdefault(b" " + b" ".join(parts[i : i + words]) + b" ", set())
                if name is not None:
                    owners.add(number[name])
        self.classes = []
        listed = sorted(windows, key=len)
        for low, high in ((0, 4), (4, 8), (8, 16), (16, None)):
            some = [w for w in listed if len(w) >= low and (high is None or len(w) < high)]
            if some:
                length = np.array([len(w) for w in some], np.int64)
                body = np.frombuffer(b"".join(some), np.uint8)
                owners = [sorted(windows[w]) for w in some]
                counts = np.array([len(o) for o in owners], np.int64)
                size = np.array([w.count(b" ") - 1 for w in some], np.int64)
                self.classes.append((WuManber(body, np.cumsum(length) - length, length), size, np.array([x for o in owners for x in o], np.int64), np.cumsum(counts) - counts, counts))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Of each normalised text: words, hit words, spans of hit words (first, words), items."""
        offset = np.cumsum([0] + [len(t) + 1 for t in texts]) + 1
        body = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        blanks = np.cumsum(body == 32, dtype=np.int32)
        before = blanks[offset - 1]  # blanks before each text
        n_words = np.maximum(np.diff(before).astype(np.int64) - 1, 0)
        base = np.cumsum(n_words) - n_words
        edge = np.zeros(int(n_words.sum()) + 1, np.int64)
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for tables, size, owners, first, counts in self.classes:
            at, which = tables.search(body)
            doc = np.searchsorted(offset, at, side="right") - 1
            word = base[doc] + blanks[at] - before[doc] - 1
            np.add.at(edge, word, 1)
            np.add.at(edge, word + size[which], -1)
            doc, which = np.unique(np.stack([doc, which]), axis=1) if len(doc) else (doc, which)
            several = counts[which]
            inside = np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
            docs.append(np.repeat(doc, several))
            items.append(owners[np.repeat(first[which], several) + inside])
        hit = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[base + n_words] - total[base]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d in np.flatnonzero(n_hit):
            own = np.concatenate([[False], hit[base[d] : base[d] + n_words[d]], [False]])
            cut = np.flatnonzero(own[1:] != own[:-1])
            spans[d] = list(zip(cut[0::2].tolist(), (cut[1::2] - cut[0::2]).tolist(), strict=True))
        found: list[list[str]] = [[] for _ in texts]
        for d, i in sorted(set(zip(np.concatenate(docs).tolist(), np.concatenate(items).tolist(), strict=True))):
            found[d].append(self.names[i])
        return n_words, n_hit, spans, found


def _search(strings: TestStrings, only_hits: bool):
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text", BATCH_BYTES):
            raw = batch.column("text").cast(pa.large_binary()).to_pylist()
            n_words, n_hit, spans, found = strings.find([normalised(r or b"") for r in raw])
            spans = [[{"first": a, "words": b} for a, b in s] for s in spans]
            out = pa.record_batch([*[batch.column(c) for c in ("doc_id", "row")], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "row", "n_words", "n_hit", "spans", "item_ids"])
            yield out.filter(pa.array(n_hit > 0)) if only_hits else out

    return run


def pieces_of(items: DataFrame, item_col: str, text_col: str, words: int) -> DataFrame:
    """``item``, ``piece``: the words of each item with single blanks between, long items cut so that every window lies in one piece."""
    upper = "".join(map(chr, range(65, 91)))
    lists = items.select(F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(F.translate(text_col, upper, upper.lower()), F.lit(WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - words, F.lit(0)), F.lit(PIECE_WINDOWS))
    cut = lists.select("item", "w", F.explode(starts).alias("s"))
    return cut.select("item", F.array_join(F.slice("w", F.col("s") + 1, F.lit(PIECE_WINDOWS + words - 1)), " ").alias("piece")).distinct()


def contamination(docs: DataFrame, items: DataFrame, words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Which words of each document lie in a window of ``words`` consecutive words of a test item.

    Words are runs of ASCII letters, digits and all characters from U+0080, A-Z lower-cased; what stands between them
    does not matter. An item of fewer words is one window; one without words has none. Result, one row per row:
    ``doc_id`` (any type), ``n_words``, ``n_hit``, ``spans`` of hit words (array of ``first`` from 0 and ``words``) and
    ``item_ids`` (as strings, sorted) of the items of which a window occurs.

    Documents are searched where they are: nothing of them is shuffled while the item text fits one pass (``pass_bytes``).
    More item text is dealt into that many passes by hash; then documents are written once with a row number, each pass keeps
    the rows it hits, and those are merged. So tasks and driver hold ``pass_bytes`` of item text at a time (one piece at least).

    Null, empty and wordless texts have no words. Null ids and repeated rows are rows like others. Items that repeat an id
    are one item; an item without an id marks words but is no item by name. Without items nothing is hit. Further
    columns of both tables are ignored.
    """
    pieces = materialise(pieces_of(items, item_col, item_text_col, words), "item-pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, n_words bigint, n_hit bigint, spans array<struct<first: bigint, words: bigint>>, item_ids array<string>"

    def strings(k: int) -> TestStrings:
        mine = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(passes)) == k)
        return TestStrings([(r["item"], r["piece"]) for r in mine.collect()], words)

    if passes == 1:
        return rows.withColumn("row", F.lit(0).cast("long")).mapInArrow(_search(strings(0), False), schema).drop("row")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = [materialise(rows.mapInArrow(_search(strings(k), k > 0), schema), "pass") for k in range(passes)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    merged = merged.withColumn("spans", _united(F.array_sort("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "item_ids")


def _united(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap made one."""
    kind = "array<struct<first: bigint, words: bigint>>"

    def take(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.greatest(last["first"] + last["words"], s["first"] + s["words"]) - last["first"]
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), longer.alias("words"))))
        apart = (F.size(done) == 0) | (s["first"] > last["first"] + last["words"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(joined)

    return F.aggregate(spans, F.array().cast(kind), take)

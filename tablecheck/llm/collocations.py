"""Collocations by stripes: every prefix of up to two words keys a counter of the words that follow it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise
from tablecheck.llm.token_files import batches
from tablecheck.llm.words import hash_words, mix

#: Words held for one set of stripes of a task; three numbers below this fit one 64-bit key.
HELD_WORDS = 1 << 21
#: Text cut into words at a time, and text per partition of the merged stripes, in bytes.
BATCH_BYTES, PART_BYTES = 2_000_000, 12_000_000
#: Bytes between pieces, and between the words of a piece.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Language of documents without one.
NO_LANGUAGE = "und"

#: A packet: the hashes of its words, its entries as places in those, their counts, and on level 1 the spelling of the words.
PACKET = "part int, hashes binary, first binary, second binary, third binary, n binary, words binary, sizes binary, lang binary, langs array<string>"
ENTRY = "level int, lang string, word string, a bigint, b bigint, c bigint, n bigint, key bigint"
#: Bits of the filter of frequent prefixes at most (16 MB): a fuller filter lets more through, and changes no count.
FILTER_BITS = 27

_BREAK, _SEPARATES = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_SEPARATES[list(BREAKS + GAPS)] = True


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal place side by side, which compresses numbers that are mostly small."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(body: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class Cut:
    """Words of some texts: hash (of word and language), whether the next word is in the same piece, and where they stand."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        raw = [b"" if t is None else t.lower() for t in texts]  # bytes.lower changes A-Z only
        self.raw = b"\n" + b"\n".join(raw) + b"\n"
        body = np.frombuffer(self.raw, np.uint8)
        apart = _SEPARATES[body]
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        self.start, stop = edge[0::2], edge[1::2]
        self.length = stop - self.start
        piece = np.cumsum(_BREAK[body], dtype=np.int32)[self.start]
        self.follows = np.append(piece[1:] == piece[:-1], False)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        doc = np.searchsorted(ends, self.start, side="right")
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], np.int32)[doc] if len(doc) else np.zeros(0, np.int32)
        names = [x.encode() for x in self.langs]
        size = np.array([len(x) + 1 for x in names], np.int64)
        salt = hash_words(np.frombuffer(b"".join(b"\n" + x for x in names), np.uint8), np.cumsum(size) - size, size)
        self.hash = mix(hash_words(body, self.start, self.length) + salt[self.lang]) if len(doc) else np.zeros(0, np.uint64)


def chain(words: list[np.ndarray]) -> np.ndarray:
    """One number of a sequence of words."""
    key = words[0]
    for w in words[1:]:
        key = mix(w + key * np.uint64(3))
    return key


class Likely:
    """Bits of the keys of frequent prefixes: says yes to all of them, and to some others."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.shift = np.uint64(64 - bits)
        self.body = np.zeros(1 << (bits - 3), np.uint8)
        for k, raw in blocks.items():
            self.body[4096 * k : 4096 * k + len(raw)] = np.frombuffer(raw, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        return (self.body[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def likely(entries: DataFrame, count: int) -> Likely:
    """The filter of the ``key`` column, its blocks of 32 768 bits put together by Spark; its size is bounded."""
    bits = min(FILTER_BITS, max(15, (16 * count).bit_length()))
    at = F.shiftrightunsigned("key", 64 - bits) + 1
    blocks = entries.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("raw"))
    return Likely(bits, {r["k"] - 1: bytes(r["raw"]) for r in blocks.collect()})


class Held:
    """Words of a task until there are enough for a set of stripes of prefixes of ``level`` - 1 words."""

    def __init__(self, parts: int, level: int, passes: Likely | None):
        self.parts, self.level, self.passes = parts, level, passes
        self.clear()

    def clear(self) -> None:
        self.cuts: list[Cut] = []
        self.hashes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.words = self.entries = 0

    def add(self, cut: Cut) -> None:
        """Keep the words of a batch, and the places where an entry begins: all its prefixes and rests may be frequent."""
        if self.level == 1:
            at = np.arange(len(cut.hash))
            self.cuts.append(cut)
        else:
            if self.level == 2:
                good = self.passes(cut.hash)
                start = cut.follows[:-1] & good[:-1] & good[1:]
            else:
                pair = cut.follows[:-1] & self.passes(chain([cut.hash[:-1], cut.hash[1:]]))
                start = pair[:-1] & pair[1:]
            at = np.flatnonzero(start)
        self.hashes.append(cut.hash)
        self.places.append(at + self.words)
        self.words += len(cut.hash)
        self.entries += len(at)

    def packets(self) -> Iterator[pa.RecordBatch]:
        """Counts of the held entries, one row per partition: stripes are split by the hash of prefix and next word."""
        langs = sorted({x for c in self.cuts for x in c.langs})
        words, places = np.concatenate(self.hashes), np.concatenate(self.places)
        for s in range(0, len(places), HELD_WORDS // self.level):
            at = places[s : s + HELD_WORDS // self.level]
            columns = [words[at + k] for k in range(self.level)]
            known = np.unique(np.concatenate(columns))
            size, key = np.uint64(len(known)), np.zeros(len(at), np.uint64)
            for c in columns:
                key = key * size + np.searchsorted(known, c).astype(np.uint64)
            if self.level == 1:
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                first = at[first]
            else:
                (key, n), first = np.unique(key, return_counts=True), None
            entry = []
            for _ in range(self.level):
                entry.insert(0, (key % size).astype(np.uint32))
                key = key // size
            yield from self._dealt(known, entry, n, langs, first)
        self.clear()

    def _dealt(self, known: np.ndarray, columns: list[np.ndarray], n: np.ndarray, langs: list[str], first: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        part = ((mix(chain([known[c] for c in columns])) >> np.uint64(20)) % np.uint64(self.parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")  # the order of the words stays
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        columns, n, first = [c[order] for c in columns], n[order].astype("<u4"), None if first is None else first[order]
        for p in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[p], edges[p + 1])
            used = np.unique(np.concatenate([c[mine] for c in columns]))
            cells = [np.searchsorted(used, c[mine]).astype("<u4") for c in columns]
            cells[0] = np.diff(cells[0], prepend=np.uint32(0))  # ascending
            spelled = (b"", b"", b"", []) if first is None else (*self._spelled(first[mine], langs), langs)
            row = [int(p), known[used].tobytes(), *map(planes, cells), *[b""] * (3 - self.level), planes(n[mine]), *spelled]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PACKET_TYPES, strict=True)], names=_PACKET_NAMES)

    def _spelled(self, at: np.ndarray, langs: list[str]) -> tuple[bytes, bytes, bytes]:
        """(letters one after the other, their sizes, languages) of the words of these numbers."""
        base = np.cumsum([0] + [len(c.hash) for c in self.cuts])
        owner = np.searchsorted(base, at, side="right") - 1
        body, sizes, lang = [b""] * len(at), np.zeros(len(at), "<u4"), np.zeros(len(at), "<u4")
        for k, cut in enumerate(self.cuts):
            mine = np.flatnonzero(owner == k)
            w = at[mine] - base[k]
            for i, a, n in zip(mine.tolist(), cut.start[w].tolist(), cut.length[w].tolist(), strict=True):
                body[i] = cut.raw[a : a + n]
            sizes[mine] = cut.length[w]
            lang[mine] = np.array([langs.index(x) for x in cut.langs], np.uint32)[cut.lang[w]]
        return b"".join(body), sizes.tobytes(), lang.tobytes()


_PACKET_NAMES = [c.split(" ")[0] for c in PACKET.split(", ")]
_PACKET_TYPES = [pa.int32(), *[pa.binary()] * (len(_PACKET_NAMES) - 2), pa.list_(pa.string())]


def _count(parts: int, level: int, passes: Likely | None):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(parts, level, passes)
        for batch in batches(stream, "text", BATCH_BYTES):
            held.add(Cut(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("lang").to_pylist()))
            if held.words > HELD_WORDS or held.entries > HELD_WORDS // level:
                yield from held.packets()
        if held.words:
            yield from held.packets()

    return run


def _merge(level: int, least: int):
    """Elementwise sum of all packets of a partition; entries counted less often than ``least`` are in no phrase of the result."""

    def merged(table: pa.Table) -> dict:
        cells = lambda name: (v.as_py() for v in table.column(name))
        known = [np.frombuffer(h, np.uint64) for h in cells("hashes")]
        columns = []
        for k, name in enumerate(["first", "second", "third"][:level]):
            places = (from_planes(c, "<u4") for c in cells(name))
            columns.append(np.concatenate([h[np.cumsum(c) if k == 0 else c] for h, c in zip(known, places, strict=True)]))
        n = np.concatenate([from_planes(c, "<u4") for c in cells("n")]).astype(np.int64)
        key = chain(columns)
        order = np.argsort(key)
        new = np.zeros(len(n), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        if (key[order][1:] == key[order][:-1])[new[1:]].any():  # unequal entries under one key may be interleaved
            order = np.lexsort(columns[::-1])
            new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        first = np.flatnonzero(new)
        out = {"columns": [c[order][first] for c in columns], "n": np.add.reduceat(n[order], first), "key": key[order][first]}
        if level == 1:
            words, langs = [], []
            for body, sizes, lang, own in zip(cells("words"), cells("sizes"), cells("lang"), cells("langs"), strict=True):
                stop = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
                words += [body[a:b] for a, b in zip([0, *stop], stop, strict=False)]
                langs += [own[i] for i in np.frombuffer(lang, "<u4").tolist()]
            out["words"], out["langs"] = [words[i].decode() for i in order[first]], [langs[i] for i in order[first]]
        return out

    def run(table: pa.Table) -> pa.Table:
        got, done = merged(table), []
        keep = np.flatnonzero(got["n"] >= least)
        cells = [pa.array(c[keep].view(np.int64)) for c in got["columns"]] + [pa.nulls(len(keep), pa.int64())] * (3 - level)
        names = [pa.nulls(len(keep), pa.string())] * 2
        if level == 1:
            names = [pa.array([got[x][i] for i in keep], pa.string()) for x in ("langs", "words")]
            langs, lang = np.unique(np.array(got["langs"], object), return_inverse=True)
            total = np.zeros(len(langs), np.int64)
            np.add.at(total, lang, got["n"])
            empty = pa.nulls(len(langs), pa.int64())
            done.append(pa.table([pa.array(np.zeros(len(langs), np.int32)), pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), empty, empty, empty, pa.array(total), empty], names=_ENTRY_NAMES))
        done.append(pa.table([pa.array(np.full(len(keep), level, np.int32)), *names, *cells, pa.array(got["n"][keep]), pa.array(got["key"][keep].view(np.int64))], names=_ENTRY_NAMES))
        return pa.concat_tables(done)

    return run


_ENTRY_NAMES = [c.split(" ")[0] for c in ENTRY.split(", ")]


def stripes(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The merged counters, written: level 1 to 3 with the hashes of the words (``a``, ``b``, ``c``) and ``n`` >= ``least``;
    level 1 names language and word; level 0 has a part of each language's number of words.

    Stripes are made prefix length by prefix length. Tasks count the stripes of what they read and send them in packets; the
    entries of a stripe are dealt by the hash of prefix and next word, so that a common prefix, however many words follow
    it, is spread over all partitions. A word or pair counted less often than ``least`` cannot be in a longer entry that
    is not, so longer entries are counted only where a filter of bounded size lets all their parts through.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(60_000, max(16, -(-size // PART_BYTES)))
    levels, passes = [], None
    for level in (1, 2, 3):
        packets = rows.mapInArrow(_count(parts, level, passes), PACKET)
        levels.append(materialise(packets.groupBy("part").applyInArrow(_merge(level, least), ENTRY), f"stripes-{level}"))
        if level < 3:
            entries = levels[-1].filter(F.col("level") == level)
            passes = likely(entries, entries.count())
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a² / (left * right)), exact for counts below 10**15."""
    wide = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"(1000000bd * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of two and three words of each language whose words go together most.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line breaks, pieces into words at blanks and
    tabs. Phrases that occur ``least`` times within pieces (overlaps included) are candidates: their score is the lowest
    of floor(1000000 a² / (l r)) over the cuts into a first part (l occurrences) and a rest (r), the earlier cut on a tie. A pair
    of words goes if a candidate of three words that holds it occurs at least ``percent`` / 100 times as often.

    Result: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the language), ``score``; by score, then a,
    descending, then phrase. Null texts count as empty, documents without a language as ``und``. Ids are not looked at:
    repeated rows count each. Empty tables, and languages without candidates, give no rows. Other columns are ignored.

    All figures come from one table of stripes: its entries for the prefix () are the words, for one word the pairs, for two
    the triples; a part's count is an entry of a shorter prefix, and the greatest entries by first and by last pair decide what goes.
    """
    table = stripes(docs, least, text_col, lang_col)
    words = materialise(table.filter("level = 1").select(F.col("a").alias("w"), "lang", "word", F.col("n").alias("f")), "stripe-words")
    totals = table.filter("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = table.filter("level = 2").select("a", "b", F.col("n").alias("f"))
    triples = table.filter("level = 3").select("a", "b", "c", F.col("n").alias("f"))

    def with_word(rows: DataFrame, on: str, as_word: str, as_count: str, lang: bool = False) -> DataFrame:
        named = words.select(F.col("w").alias(on), F.col("word").alias(as_word), F.col("f").alias(as_count), *(["lang"] if lang else []))
        return rows.join(named, on)

    longer = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("most"))
    alone = pairs.join(longer, ["a", "b"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("f")))
    two = with_word(with_word(alone, "a", "x", "l", lang=True), "b", "y", "r")
    two = two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("f").alias("a"), "l", "r", _score("f", "l", "r").alias("score"))

    three = triples.join(pairs.select("a", "b", F.col("f").alias("first_two")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("last_two")), ["b", "c"])
    three = with_word(with_word(with_word(three, "a", "x", "f1", lang=True), "b", "y", "f2"), "c", "z", "f3")
    three = three.withColumns({"one": _score("f", "f1", "last_two"), "other": _score("f", "first_two", "f3")})
    early = F.col("one") <= F.col("other")
    pick = lambda a, b: F.when(early, F.col(a)).otherwise(F.col(b))
    three = three.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("f").alias("a"), pick("f1", "first_two").alias("l"), pick("last_two", "f3").alias("r"), pick("one", "other").alias("score"))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Language of words and documents: a linear-chain conditional random field with learned transitions."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.common import BLANKS, give_back, materialise, spread_key, unit
from tablecheck.llm.words import hash_words, split_words

#: Sizes of the hashed feature tables: n-grams, affixes, lexicon.
GRAMS, AFFIXES, LEXICON = 1 << 16, 1 << 15, 1 << 17
#: Text judged together, in bytes.
STEP_BYTES = 1_000_000
UNKNOWN = "und"


@dataclass
class Words:
    """Feature numbers of all words of some texts."""

    start: np.ndarray  # of each word in grams
    grams: np.ndarray  # two columns: byte pairs and triples
    affixes: np.ndarray  # two columns: first and last three bytes
    lexicon: np.ndarray
    letters: np.ndarray  # whether the word has one
    counts: np.ndarray  # words of each text


def lower_utf8(raw: bytes) -> bytes:
    return raw.decode().lower().encode()


def features(texts: list[str | None]) -> Words:
    body, start, length, counts = split_words(texts, lower_utf8)
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length) + np.repeat(start, length)
    flat = np.where((body == 32) | ((body >= 9) & (body <= 13)), 32, body).astype(np.uint32)
    before, here, after = flat[at - 1], flat[at], flat[at + 1]
    pair = (before * np.uint32(0x9E3779B1) ^ here * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    triple = (before * np.uint32(0xC2B2AE35) ^ here * np.uint32(0x27D4EB2F) ^ after * np.uint32(0x165667B1)) >> np.uint32(16)
    grams = np.stack([pair, triple], axis=1).astype(np.int64) & (GRAMS - 1)
    long = length >= 3
    stop = start + length

    def three(a: np.ndarray, tag: int) -> np.ndarray:
        a = np.where(long, a, start)
        h = flat[a] * np.uint32(0x9E3779B1) ^ flat[np.where(long, a + 1, a)] * np.uint32(0x85EBCA6B) ^ flat[np.where(long, a + 2, stop - 1)] * np.uint32(0xC2B2AE35)
        return ((h ^ np.uint32(tag)) * np.uint32(0x27D4EB2F)) >> np.uint32(17)

    affixes = np.stack([three(start, 1), three(stop - 3, 2)], axis=1).astype(np.int64) & (AFFIXES - 1)
    lexicon = (hash_words(body, start, length) & np.uint64(LEXICON - 1)).astype(np.int64)
    letter = ((flat >= 97) & (flat <= 122)) | (flat >= 128)
    letters = np.add.reduceat(letter[at], first) > 0 if len(first) else np.zeros(0, bool)
    return Words(first, grams, affixes, lexicon, letters, counts)


@dataclass
class LanguageCrf:
    """Weights of the field. Learned by :func:`fit`; small, and sent to every task."""

    langs: list[str]
    grams: np.ndarray = field(repr=False)
    affixes: np.ndarray = field(repr=False)
    lexicon: np.ndarray = field(repr=False)  # log odds of a word's bucket, not learned by gradient
    lexicon_weight: np.ndarray = field(repr=False)
    transitions: np.ndarray = field(repr=False)
    begin: np.ndarray = field(repr=False)

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.grams[w.grams[:, 0]], w.start, axis=0)
        out += np.add.reduceat(self.grams[w.grams[:, 1]], w.start, axis=0)
        return out + self.affixes[w.affixes[:, 0]] + self.affixes[w.affixes[:, 1]] + self.lexicon_weight * self.lexicon[w.lexicon]

    def marginals(self, w: Words) -> np.ndarray:
        """Probability of each language for each word, by forward-backward along each text."""
        p = self.emissions(w).astype(np.float64)
        if not len(p):
            return p
        p = np.exp(p - p.max(axis=1, keepdims=True))
        order = np.argsort(-w.counts, kind="stable")
        offset, size = (np.cumsum(w.counts) - w.counts)[order], w.counts[order]
        move, begin = np.exp(self.transitions), np.exp(self.begin)
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # texts longer than t
        forward, backward = np.empty_like(p), np.ones_like(p)
        a = begin * p[offset[: active[0]]]
        a /= a.sum(axis=1, keepdims=True)
        forward[offset[: active[0]]] = a
        for t in range(1, len(active)):
            i = offset[: active[t]] + t
            a = (a[: active[t]] @ move) * p[i]
            a /= a.sum(axis=1, keepdims=True)
            forward[i] = a
        for t in range(len(active) - 2, -1, -1):
            i = offset[: active[t + 1]] + t
            b = (p[i + 1] * backward[i + 1]) @ move.T
            backward[i] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return both / both.sum(axis=1, keepdims=True)


def _segments(texts: list[str], labels: list[int], rng: np.random.Generator, steps: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """Training chains of ``steps`` words: spans of texts of different languages put one behind the other, so that
    switches occur as they do in mixed text. (word numbers, labels, features)."""
    w = features(texts)
    offset = np.cumsum(w.counts) - w.counts
    by_label = [np.flatnonzero((np.array(labels) == k) & (w.counts > 0)) for k in range(max(labels) + 1)]
    usable = [k for k, docs in enumerate(by_label) if len(docs)]
    chains, tags = [], []
    for _ in range(max(512, min(6000, 2 * len(w.start) // steps))):
        chain, tag = [], []
        while len(chain) < steps:
            k = usable[rng.integers(len(usable))]
            d = by_label[k][rng.integers(len(by_label[k]))]
            span = min(int(rng.integers(4, 2 * steps)), int(w.counts[d]))
            s = int(rng.integers(0, w.counts[d] - span + 1))
            chain += range(offset[d] + s, offset[d] + s + span)
            tag += [k] * span
        chains.append(chain[:steps])
        tags.append(tag[:steps])
    return np.array(chains), np.array(tags), w


def fit(texts: list[str], langs: list[str], steps: int = 32, epochs: int = 8, rate: float = 0.05, l2: float = 1e-6, seed: int = 7) -> LanguageCrf:
    """Maximum conditional likelihood by gradient steps; the gradient comes from forward-backward.

    After half of the epochs, chains whose own labels the field finds less likely than not are left out: parts of
    labelled texts are written in another language.
    """
    names = sorted(set(langs))
    labels = [names.index(x) for x in langs]
    n = len(names)
    rng = np.random.default_rng(seed)
    chains, tags, w = _segments(texts, labels, rng, steps)
    of_word = np.repeat(np.array(labels), w.counts)
    counts = np.stack([np.bincount(w.lexicon[of_word == k], minlength=LEXICON) for k in range(n)], axis=1) + 0.5
    odds = np.log(counts / counts.sum(axis=0))
    odds = np.clip(odds - odds.mean(axis=1, keepdims=True), -4, 4).astype(np.float32)
    odds[(counts <= 0.5).all(axis=1)] = 0
    crf = LanguageCrf(names, np.zeros((GRAMS, n), np.float32), np.zeros((AFFIXES, n), np.float32), odds, np.full(n, 0.5, np.float32), np.zeros((n, n)), np.zeros(n))
    params = [crf.grams, crf.affixes, crf.lexicon_weight, crf.transitions, crf.begin]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    bytes_of = np.diff(np.concatenate([w.start, [len(w.grams)]]))
    step = 0
    for epoch in range(epochs):
        likely = []
        for chosen in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 256)):
            word, tag = chains[chosen], tags[chosen]
            flat = word.ravel()
            size = bytes_of[flat]
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(w.start[flat], size)
            sub = Words(first, w.grams[at], w.affixes[flat], w.lexicon[flat], w.letters[flat], np.full(len(chosen), steps))
            e = crf.emissions(sub).reshape(len(chosen), steps, n).astype(np.float64)
            p = np.exp(e - e.max(axis=2, keepdims=True))
            move = np.exp(crf.transitions)
            f, b = np.empty_like(p), np.ones_like(p)
            f[:, 0] = np.exp(crf.begin) * p[:, 0]
            f[:, 0] /= f[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, steps):
                f[:, t] = (f[:, t - 1] @ move) * p[:, t]
                f[:, t] /= f[:, t].sum(axis=1, keepdims=True)
            for t in range(steps - 2, -1, -1):
                b[:, t] = (p[:, t + 1] * b[:, t + 1]) @ move.T
                b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
            m = f * b
            m /= m.sum(axis=2, keepdims=True)
            pairs = f[:, :-1, :, None] * move * (p * b)[:, 1:, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            own = np.take_along_axis(m, tag[:, :, None], axis=2)[:, :, 0]
            likely.append((chosen, own.mean(axis=1)))
            wrong = m.copy()
            np.put_along_axis(wrong, tag[:, :, None], own[:, :, None] - 1, axis=2)
            scale = 1 / len(flat)
            d = (wrong.reshape(-1, n) * scale).astype(np.float32)
            per_byte = np.repeat(d, size, axis=0)
            grads = [np.zeros_like(x) for x in params]
            np.add.at(grads[0], sub.grams[:, 0], per_byte)
            np.add.at(grads[0], sub.grams[:, 1], per_byte)
            np.add.at(grads[1], sub.affixes[:, 0], d)
            np.add.at(grads[1], sub.affixes[:, 1], d)
            grads[2] = (d * odds[sub.lexicon]).sum(axis=0)
            seen = np.zeros((n, n))
            np.add.at(seen, (tag[:, :-1].ravel(), tag[:, 1:].ravel()), 1)
            grads[3] = (pairs.sum(axis=(0, 1)) - seen) * scale
            grads[4] = (m[:, 0].sum(axis=0) - np.bincount(tag[:, 0], minlength=n)) * scale
            step += 1
            for x, g, (u, v) in zip(params, grads, moments, strict=True):
                g = g + l2 * x
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                x -= (rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(x.dtype)
        if epoch == epochs // 2:
            order = np.concatenate([c for c, _ in likely])
            keep = np.concatenate([x for _, x in likely]) >= 0.5
            if keep.any():
                chains, tags = chains[order[keep]], tags[order[keep]]
    return crf


def labelled_sample(docs: DataFrame, per_lang: int, chars: int, id_col: str, text_col: str, lang_col: str, most_langs: int = 256, seed: str = "crf") -> tuple[list[str], list[str]]:
    """At most ``per_lang`` texts of each language, in an order hashed from id and text, runs of white space as one blank.

    Together they have at most ``chars`` characters of a language: where there are more, texts above one common length are
    cut to a span of that length at a hashed place, so that every drawn text has a part. Rows that repeat id and text count once.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), spread_key(seed, F.col(id_col), F.xxhash64(text_col)).alias("k"))
    sizes = materialise(rows.groupBy("lang").agg(F.approx_count_distinct("k").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs), "languages")
    chars = min(chars, max(1, 8 * chars // max(1, sizes.count())))
    drawn = rows.join(F.broadcast(sizes), "lang").filter(unit(F.col("k")) * F.col("n") < 1.5 * per_lang + 20)
    drawn = drawn.groupBy("lang", "k").agg(F.first("text").alias("text"))
    drawn = materialise(drawn.withColumn("text", F.trim(F.regexp_replace("text", f"{BLANKS}+", " "))), "drawn")
    order = Window.partitionBy("lang").orderBy("k")
    parts = drawn.select("lang", "k", F.char_length("text").cast("long").alias("n")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang)
    by_size, whole = Window.partitionBy("lang").orderBy("n", "k"), Window.partitionBy("lang")
    before = F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.lit(chars) - before) / (F.count("*").over(whole) - F.row_number().over(by_size) + 1)  # what the texts from here on have each
    parts = parts.withColumn("level", level).withColumn("most", F.greatest(F.floor(F.max("level").over(whole)).cast("long"), F.lit(1)))
    start = F.pmod(F.col("k"), F.greatest(F.col("n") - F.col("most"), F.lit(0)) + 1) + 1
    span = F.substring(F.col("text"), start.cast("int"), F.least("most", "n").cast("int"))
    got = drawn.join(F.broadcast(parts), ["lang", "k"]).select("lang", "r", (F.col("n") > F.col("most")).alias("cut"), span.alias("text")).collect()
    got = sorted(got, key=lambda g: (g["lang"], g["r"]))
    return [_whole_words(g["text"]) if g["cut"] else g["text"] for g in got], [g["lang"] for g in got]


def _whole_words(span: str) -> str:
    """Without the words cut at both ends, if others are left."""
    return " ".join(span.split(" ")[1:-1]) or span


def held_out_column(id_col: str = "doc_id"):
    """Whether crc32 of the id mod 5 is 0; not of a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 200, chars: int = 4_000_000, most_langs: int = 256) -> LanguageCrf | None:
    """Fit on a bounded sample of the labelled rows that are not held out (crc32 of the id mod 5 is not 0): ``per_lang``
    texts and ``chars`` characters of each language, spans of texts where they are longer; from eight languages up they
    share ``8 * chars``. Of more than ``most_langs`` values of the language column those with the most labelled texts
    are learned, so that sample and model are bounded. None if no labelled text has a word."""
    texts, langs = labelled_sample(docs.filter(~held_out_column(id_col)), per_lang, chars, id_col, text_col, lang_col, most_langs)
    return fit(texts, langs) if texts else None


def predict_languages(docs: DataFrame, crf: LanguageCrf | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Language of every whole text: ``doc_id``, ``lang_pred``, ``score``; with ``spans`` also the runs of words of one
    language (``lang``, ``first`` word from 0, ``words``). ``carry``: further columns to keep.

    ``score`` is the mean probability of ``lang_pred`` over the words that have a letter. ``und`` with score 0 if the
    text is null or has no letter, or nothing could be learned. The text alone decides. One row per row, in place:
    nothing is shuffled, and only the text goes to Python; null ids and repeated rows are rows like others. Ids keep
    their type. Carried columns named like a result column are replaced.
    """
    carry = [c for c in (carry or []) if c not in ("doc_id", "lang_pred", "score", "spans")]
    run = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]))))

    @F.arrow_udf(T.StructType(fields))
    def judge(text: pa.Array) -> pa.Array:
        best, score, runs = classify_by_length(text, crf, spans)
        give_back()
        columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), *([pa.array(runs, pa.list_(run))] if spans else [])]
        return pa.StructArray.from_arrays(columns, names=[f.name for f in fields])

    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry], judge(F.col(text_col)).alias("__judged"))
    return rows.select("doc_id", *[F.col(f"__judged.{f.name}").alias(f.name) for f in fields], *[F.col(c) for c in carry])


def classify_by_length(column: pa.Array, crf: LanguageCrf | None, spans: bool) -> tuple[list[str], list[float], list[list[dict]]]:
    """:func:`classify` of texts of like length together, about ``STEP_BYTES`` at a time (one text at least): the chains of
    a step then end at about the same word, and what a task holds does not grow with the batch."""
    size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    best, score, runs = [UNKNOWN] * len(size), [0.0] * len(size), [[] for _ in size]
    total, start = np.cumsum(size[order]), 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + STEP_BYTES, side="right")))
        some = order[start:stop]
        for i, lang, sure, parts in zip_longest(some.tolist(), *classify(column.take(pa.array(some)).to_pylist(), crf, spans)):
            best[i], score[i], runs[i] = lang, sure, parts
        start = stop
    return best, score, runs


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def classify(texts: list[str | None], crf: LanguageCrf | None, spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, runs of words) of each text."""
    known = np.array([crf is not None and has_letter(t) for t in texts])
    if not known.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    w = features([t if k else None for t, k in zip(texts, known, strict=True)])
    m = crf.marginals(w)
    text_of = np.repeat(np.arange(len(texts)), w.counts)
    counted = np.where(w.letters, 1.0, 1e-9)  # a text whose letters the byte test misses still counts
    total = np.bincount(text_of, counted, len(texts))
    share = np.stack([np.bincount(text_of, m[:, k] * counted, len(texts)) for k in range(len(crf.langs))], axis=1)
    best = share.argmax(axis=1)
    score = np.where(known, share.max(axis=1) / np.maximum(total, 1e-300), 0.0).clip(0, 1)
    label = m.argmax(axis=1)
    offset = np.cumsum(w.counts) - w.counts
    runs: list[list[dict]] = []
    for o, c in zip(offset, w.counts, strict=True) if spans else ():
        some = label[o : o + c]
        cut = np.concatenate([[0], np.flatnonzero(some[1:] != some[:-1]) + 1, [c]]) if c else np.zeros(1, int)
        runs.append([{"lang": crf.langs[some[a]], "first": int(a), "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return [crf.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score.tolist(), runs

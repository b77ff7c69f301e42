"""SentencePiece models run by the tokenizers library: rebuilt from the model file, checked piece by piece."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import give_back
from tablecheck.llm.pieces import PieceStore, cut_pieces, tokenizer_path
from tablecheck.llm.token_files import batches

#: Fixed values of the model format: the space marker, model types, piece types.
SPACE, UNIGRAM, BPE, UNKNOWN, CONTROL, BYTE = "▁", 1, 2, 2, 3, 6
#: Text encoded together, in bytes, and pieces a worker remembers before it starts anew.
BATCH_BYTES, PIECES = 1_000_000, 200_000
#: Pieces encoded and checked as one string; flags of a piece whose ids differ, or that decoding does not give again.
JOINED, DIFFERS, LOST = 64, 1, 2
ENCODED_SCHEMA = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean"


class Backend:
    """A model as the tokenizers library runs it, with the sentencepiece library beside it for the parity check.

    ``normalise`` turns texts into what is segmented (the model's character map, blanks), with spaces for space markers;
    ``cuts`` tells where no entry of the vocabulary could lie across; ``encode`` segments texts cut there.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"model type {trainer.model_type} is neither unigram nor byte pairs")
        if trainer.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only models that mark a space before a word are read")
        rows = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.byte_fallback = any(t == BYTE for _, _, t in rows)
        self.unk_id = next((i for i, (_, _, t) in enumerate(rows) if t == UNKNOWN), 0)
        if trainer.model_type == UNIGRAM:
            # control and byte pieces are never found in text: they keep their ids under a score out of reach
            self.model = models.Unigram([(p, s if t not in (CONTROL, BYTE, UNKNOWN) else -1e9) for p, s, t in rows], self.unk_id, self.byte_fallback)
        else:
            vocabulary = {p: i for i, (p, _, _) in enumerate(rows)}
            usable = {p: s for p, s, t in rows if t not in (CONTROL, BYTE, UNKNOWN)}
            merges = [(-s, -cut, p[:cut], p[cut:]) for p, s in usable.items() for cut in range(1, len(p)) if p[:cut] in usable and p[cut:] in usable]
            self.model = models.BPE(vocabulary, [(a, b) for _, _, a, b in sorted(merges)], unk_token=rows[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        self.tokenizer = Tokenizer(self.model)

        steps = []
        if norm.precompiled_charsmap:
            steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
        if norm.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        if norm.add_dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        steps.append(normalizers.Replace(" ", SPACE))
        self.normaliser = normalizers.Sequence(steps)
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        # a piece with a space marker behind a letter would span words; none has, in most models
        self.spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, t in rows if t not in (CONTROL, BYTE, UNKNOWN))
        self.lines = self.byte_fallback and not any("\n" in p for p, _, _ in rows)
        # a space and a word have one id that begins with the space, so strings of them are cut again; sums of scores
        # over long strings would round otherwise than over words
        self.begins = np.array([p.startswith(SPACE) and t not in (CONTROL, BYTE, UNKNOWN) for p, _, t in rows])
        self.joins = trainer.model_type == BPE and not self.spans

        fuse = [decoders.ByteFallback()] if self.byte_fallback else []
        self.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), *fuse, decoders.Fuse()])
        self.names = [p for p, _, _ in rows]
        self.silent = frozenset(i for i, (_, _, t) in enumerate(rows) if t == CONTROL)
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.precompiled_charsmap = b""
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.store = PieceStore(self._learn, PIECES)

    def normalise(self, texts: pa.Array) -> pa.Array:
        if self.plain:
            spaced = pa.compute.replace_substring(pa.compute.fill_null(texts, ""), SPACE, " ")
            led = pa.compute.binary_join_element_wise(self.prefix.replace(SPACE, " "), spaced, "")
            return pa.compute.if_else(pa.compute.equal(spaced, ""), "", led)
        return pa.array([self.normaliser.normalize_str(t).replace(SPACE, " ") if t else "" for t in texts.to_pylist()], pa.string())

    def cuts(self, body: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """Before spaces that follow something else, and around line breaks if no entry has any."""
        if self.spans:
            return np.zeros(len(body), bool)
        before = np.append(np.uint8(0), body[:-1])[: len(body)]
        cut = (body == 32) & (before != 32)
        return cut | (body == 10) | (before == 10) if self.lines else cut

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where those of each piece start and how many they are, and flags."""
        words = [k for k, p in enumerate(pieces) if len(p) > 1 and p.rfind(" ") == 0] if self.joins else []
        strings = ["".join([pieces[k] for k in words[i : i + JOINED]]) for i in range(0, len(words), JOINED)]
        starts, sizes, flags = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.uint8)
        alone, found, held = np.ones(len(pieces), bool), [np.zeros(0, np.uint32)], 0
        for i, (ids, wrong) in enumerate(self._check(strings)):
            some, got = words[i * JOINED : (i + 1) * JOINED], np.array(ids, np.uint32)
            edges = np.flatnonzero(self.begins[got])
            if wrong or len(edges) != len(some):
                continue  # the words are told apart one by one below
            starts[some], sizes[some], alone[some] = held + edges, np.diff(edges, append=len(got)), False
            found.append(got)
            held += len(got)
        rest = np.flatnonzero(alone)
        checked = self._check([pieces[k] for k in rest])
        flags[rest] = [wrong for _, wrong in checked]
        sizes[rest] = [len(ids) for ids, _ in checked]
        starts[rest] = held + np.cumsum(sizes[rest]) - sizes[rest]
        return np.concatenate([*found, np.array([x for ids, _ in checked for x in ids], np.uint32)]), starts, sizes, flags

    def _check(self, strings: list[str]) -> list[tuple[list[int], int]]:
        """(ids, flags) of each string, in one threaded batch."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([s.replace(" ", SPACE) for s in strings], add_special_tokens=False)]
        told = self.reference.encode(strings, num_threads=1)
        return [(g, DIFFERS * (g != t) | LOST * (self.text(g) != s)) for g, t, s in zip(got, told, strings, strict=True)]

    def text(self, ids: list[int]) -> str:
        """Decoded without removing the space put before a text."""
        return self.decoder.decode([self.names[i] for i in ids if i not in self.silent])

    def decode(self, ids: list[int]) -> str:
        text = self.text(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, how many each has, and its flags."""
        return self.store.ids(*cut_pieces(self.normalise(texts), self.cuts), None)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Of each text: ids as little-endian 32-bit integers, parity, round trip of the normalised text."""
        ids, sizes, flags = self.encode(pa.array(texts, pa.string()))
        parts = np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1]) if texts else []
        return [(x.tobytes(), not f & DIFFERS, not f & LOST) for x, f in zip(parts, flags.tolist(), strict=True)]


@lru_cache(maxsize=2)
def backend(path: str, threads: int) -> Backend:
    """The model of a file, loaded once per worker; ``threads`` for the library's own pool."""
    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true" if threads > 1 else "false"
    with open(path, "rb") as f:
        return Backend(f.read())


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", threads: int = 2, with_ids: bool = False) -> DataFrame:
    """Encode every whole text: ``doc_id``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit
    integers), ``parity`` (the ids are those of the sentencepiece library), ``round_trip`` (decoding gives the
    normalised text), and with ``with_ids`` the ``ids``. One row per row, in place: nothing is shuffled.

    Every distinct piece of every text is checked, as texts are encoded piece by piece. Null and empty texts have no
    ids, parity and round trip; repeated rows and null ids are rows like others; other columns are ignored.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = backend(tokenizer_path(model), threads)
        for batch in batches(stream, "text", BATCH_BYTES):
            ids, size, flags = here.encode(batch.column("text"))
            ids, stops = ids.astype("<u4"), np.append(0, np.cumsum(size))
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array(size), pa.array(crc, pa.int64()), pa.array(flags & DIFFERS == 0), pa.array(flags & LOST == 0)]
            names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids.view("<i4"))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ENCODED_SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of ``ids``: ``doc_id``, ``text``. Null ids give a null text, no ids an empty one."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = backend(tokenizer_path(model), 1)
        for batch in stream:
            texts = [None if ids is None else here.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")

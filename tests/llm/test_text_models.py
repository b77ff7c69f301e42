"""Languages, token files, SentencePiece models and the language model, beside plain versions of each."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import language_crf as crf_module
from tablecheck.llm import token_files
from tablecheck.llm.katz import discounts, from_sized, katz_scores, planes, from_planes, sized
from tablecheck.llm.language_crf import classify, fit, labelled_sample, learn_languages, predict_languages
from tablecheck.llm.sentencepiece_backend import Backend, decode_documents, encode_documents
from tablecheck.llm.token_files import encode_texts, pack, read_token_files, unpack, write_token_files
from tablecheck.llm.pieces import cut_pieces, tokenizer_path
from tablecheck.llm.words import word_hashes
from tests.llm.helpers import docs, empty, given

ODD = ["", " ", "\n", "  a   b ", "a\n\n b\n", "▁▁x ▁", "日本語 テキスト🎉 é́", "a" * 5000, "\t\tx\r\n", "     " * 7 + "x", "the\x1cend \x85 x", "　full space  ", "<|endoftext|> hi<|endoftext|>",
       "it's we'll  don't \n 's ''s", "ﬁ ½ x² àà", "A" + "̈", "\xa0nbsp \xa0 x", "mixed.Case,and;punct!?", "the " * 20000]


def odd_texts(n=400):
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "a", "th", "é", "1", "'s", "'", "!", "ß", "日", "\x1c", "\xa0", "🎉", ".", "The", " of"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_word_hashes():
    texts = [None, "", " ", "A b\tc", "a  B\x0bc", "\xa0x", "é É", "a" * 3000, "a" * 3001]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().lower().split()) for t in texts]
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))


# languages


def train_rows():
    d = given("documents")
    return d.text.tolist(), d.lang.tolist()


def test_forward_backward_beside_all_paths():
    texts, langs = train_rows()
    crf = fit(texts[:60], langs[:60], epochs=2)
    some = ["the of haan", None, "der", "", "der die und le"]
    w = crf_module.features(some)
    got, e = crf.marginals(w), crf.emissions(w).astype(float)
    start = np.cumsum(w.counts) - w.counts
    n = len(crf.langs)
    for s, c in zip(start, w.counts):
        want, total = np.zeros((c, n)), 0.0
        for path in np.ndindex(*[n] * c) if c else ():
            weight = math.exp(crf.begin[path[0]] + sum(e[s + t, k] for t, k in enumerate(path)) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for t, k in enumerate(path):
                want[t, k] += weight
        if c:
            assert got[s : s + c] == pytest.approx(want / total, rel=1e-6)


def test_gradient_steps_learn_switches():
    texts, langs = train_rows()
    crf = fit(texts, langs)
    assert (np.diag(crf.transitions)[:, None] >= crf.transitions).all()
    de, en = (next(" ".join(t.split()[:120]) for t, x in zip(texts, langs) if x == lang and len(t.split()) > 150 and "#" not in t) for lang in ("de", "en"))
    (_, _, runs) = classify([f"{en} {de}"], crf)
    longest = sorted(runs[0], key=lambda r: -r["words"])[:2]
    assert {r["lang"] for r in longest} == {"de", "en"} and all(r["words"] > 100 for r in longest)


def test_languages_of_rows(spark):
    texts, langs = train_rows()
    rows = [(1000 + i, t, x) for i, (t, x) in enumerate(zip(texts, langs))] + [(1, None, "en"), (2, "", "en"), (3, "12 % 34 .", "de"), (None, "und der die", None), (5, "the of", None), (5, "the of", None), (6, "the of haan " * 9000, "en")]
    table = docs(spark, rows)
    model = learn_languages(table)
    got = predict_languages(table, model, carry=["score", "key"], spans=True).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    by = got.set_index("doc_id")
    assert by.lang_pred[[1, 2, 3]].tolist() == ["und"] * 3 and by.score[[1, 2, 3]].tolist() == [0, 0, 0]
    assert by.lang_pred[6] == "en" and sum(r["words"] for r in by.spans[6]) == 27000
    held = [i for i in range(len(texts)) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    right = [by.lang_pred[1000 + i] == langs[i] for i in held]
    assert np.mean(right) > 0.9


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert learn_languages(docs(spark, [(i, "der die das", "de") for i in held])) is None
    assert predict_languages(docs(spark, [(1, "der")]), None).first()["lang_pred"] == "und"
    assert learn_languages(empty(spark)) is None and predict_languages(empty(spark), None).count() == 0


def test_a_long_text_leaves_room_for_others(spark):
    long = "der die das " * 50_000
    rows = [(i, long, "de") for i in range(1, 20)] + [(100 + i, f"und der {i}", "de") for i in range(60)] + [(300 + i, f"the of {i}", "en") for i in range(60)]
    texts, langs = labelled_sample(docs(spark, rows), 200, 20_000, "doc_id", "text", "lang")
    assert langs.count("de") == 79 and langs.count("en") == 60 and sum(len(t) for t, x in zip(texts, langs) if x == "de") <= 20_000
    assert {t for t in texts if len(t) < 20} >= {f"und der {i}" for i in range(60)} and all({*t.split()} <= {"der", "die", "das"} for t in texts if len(t) > 20)
    model = learn_languages(docs(spark, [(1, long, "de"), *[(300 + i, f"the of {i}", "en") for i in range(60)]]), chars=5000)
    assert model.langs == ["de", "en"]
    assert labelled_sample(docs(spark, [(1, " \n", "de")]), 9, 9, "doc_id", "text", "lang") == ([], [])


def test_rows_without_id_teach(spark):
    rows = [(None, f"der die das und {i}", "de") for i in range(600)] + [(None, f"the of and {i}", "en") for i in range(600)] + [(None, "le la les", "fr")] * 600
    texts, langs = labelled_sample(docs(spark, rows), 200, 4_000_000, "doc_id", "text", "lang")
    assert (langs.count("de"), langs.count("en"), langs.count("fr")) == (200, 200, 1) and len(set(texts)) == 401


# token files


def test_pack_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for values in (x, x[:5], x[:0], np.random.default_rng(0).integers(0, 2**17, 1001).astype(np.uint32)):
        assert (unpack(*pack(values), len(values)) == values).all()
    control, data = pack(np.array([7, 300], np.uint32))
    assert control == bytes([0b0100]) and data == bytes([7, 44, 1])


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = odd_texts() + given("documents").text.tolist()
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    got = encode_texts(texts, path, 0)
    assert [np.frombuffer(g, "<u4").tolist()[:-1] for g in got] == want


def test_white_space_and_signs_are_cut_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(2)
    alphabet = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u3000", "\ufeff", "a", "Th", "é", "\u0301", "1", "'s", "'", ".", "|", "<|endoftext|>", "日", "🎉", "²"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist()[:-1] for g in encode_texts(texts, path, 0)] == want


def test_equal_pieces_of_a_batch_are_looked_up_once(monkeypatch):
    path, looked = tokenizer_path("byte_bpe_50k.json"), []

    class Numbers(defaultdict):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    table = token_files._encoder(path)
    numbers = Numbers(table.numbers.default_factory)
    numbers.update(table.numbers)
    monkeypatch.setattr(table, "numbers", numbers)
    ids = [np.frombuffer(g, "<u4") for g in encode_texts(["the of " * 20_000, None, "of the"], path, 0)]
    assert [len(x) for x in ids] == [40_002, 1, 3] and ids[1].tolist() == [0] and len(looked) <= 10  # 40 003 before


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(odd_texts(100))] + [(None, "x"), (50, None), (50, "twice"), (50, "twice"), (-3, "first")]
    write_token_files(docs(spark, rows).repartition(3), str(tmp_path / "f"))
    got = read_token_files(spark, str(tmp_path / "f")).toPandas().sort_values("start")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for _, t in order]
    n = np.array([len(x) for x in ids])
    assert got.doc_id.fillna(-99).tolist() == [-99 if i is None else i for i, _ in order]
    assert got.start.tolist() == (np.cumsum(n) - n).tolist() and got.n_tokens.tolist() == n.tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_token_files_empty(spark, tmp_path):
    write_token_files(empty(spark), str(tmp_path / "f"))
    assert read_token_files(spark, str(tmp_path / "f")).count() == 0


# SentencePiece


def unigram_model(**normal):
    """A small model with byte fallback written by hand; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    for name, value in {"add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True, **normal}.items():
        setattr(proto.normalizer_spec, name, value)
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rows += [(c, -6.0 - i / 10, 1) for i, c in enumerate("▁abcdehinorst")] + [("▁the", -2.0, 1), ("th", -3.5, 1), ("he", -3.6, 1), ("er", -3.7, 1), ("▁a", -2.9, 1), ("and", -3.1, 1), ("▁▁", -5.0, 1)]
    for piece, score, kind in rows:
        proto.pieces.add(piece=piece, score=score, type=kind)
    return proto.SerializeToString()


@pytest.mark.parametrize("normal", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": True}])
def test_unigram_parity(normal):
    import sentencepiece

    model = unigram_model(**normal)
    here, there = Backend(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["the other hand", "", "a  the   and ", " there\nand z", "ther é日", "  ", "tttthhheee"]
    got = here.encode_batch(texts)
    assert [np.frombuffer(g[0], "<u4").tolist() for g in got] == there.encode(texts)
    assert all(g[1] and g[2] for g in got)


def test_pair_model_parity_and_decoding(spark):
    import sentencepiece

    there = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts() + given("documents").text.tolist()
    rows = [*enumerate(texts), (None, None), (3, "again"), (3, "again")]
    encoded = encode_documents(docs(spark, rows), with_ids=True)
    got = encoded.toPandas()
    want = [(i, there.encode(t or "")) for i, t in rows]
    assert sorted((-1 if np.isnan(i) else int(i), list(x)) for i, x in zip(got.doc_id, got.ids)) == sorted((-1 if i is None else i, x) for i, x in want)
    assert got.parity.all() and got.round_trip.all() and (got.n_tokens == got.ids.str.len()).all()
    assert set(got.ids_crc32) == {zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want}
    back = decode_documents(encoded).toPandas()
    plain = sorted((-1 if i is None else i, (t or "").replace("▁", " ")) for i, t in rows)
    assert sorted((-1 if np.isnan(i) else int(i), t) for i, t in zip(back.doc_id, back.text)) == plain


def test_pieces_are_checked_together(monkeypatch):
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        here = Backend(f.read())
    calls, text = [], here.text
    monkeypatch.setattr(here, "text", lambda ids: calls.append(len(ids)) or text(ids))
    words = [f"w{i}é{i * 7919 % 1000}" for i in range(3000)]
    got = here.encode_batch([" ".join(words[i : i + 300]) for i in range(0, 3000, 300)])
    assert all(g[1] and g[2] for g in got) and len(calls) <= 300  # 3000 when each word was checked by itself


def test_a_piece_that_differs_marks_its_texts_alone():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        here = Backend(f.read())
    true, told = here.reference, here.text

    class Reference:
        def encode(self, strings, num_threads):
            return [[*ids, 7] if "wrong" in s else ids for s, ids in zip(strings, true.encode(strings, num_threads=1))]

    want = true.encode([" a wrong b", " a right b", " a lost b", "", " lost wrong"])
    here.reference, here.text = Reference(), lambda ids: told(ids).replace("lost", "")
    got = here.encode_batch(["a wrong b", "a right b", "a lost b", "", "lost wrong"])
    assert [np.frombuffer(g[0], "<u4").tolist() for g in got] == want
    assert [g[1:] for g in got] == [(False, True), (True, True), (True, False), (True, True), (False, False)]


def test_cuts_beside_the_pattern():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        here = Backend(f.read())
    texts = ["left out", None, *odd_texts(), "", None, "a ", " b", "\n", "c"]
    normal = here.normalise(pa.array(texts)[1:])
    distinct, places, pieces = cut_pieces(normal, here.cuts)
    got = np.split(np.array(distinct, object)[places], np.cumsum(pieces)[:-1])
    assert normal.to_pylist() == [" " * bool(t) + (t or "").replace("▁", " ") for t in texts[1:]]
    assert [list(g) for g in got] == [re.findall(r" *[^ \n]+|\n| +", t) for t in normal.to_pylist()] and len(set(distinct)) == len(distinct)
    assert cut_pieces(pa.array([], pa.string()), here.cuts)[0] == [] and cut_pieces(pa.array([None, ""], pa.string()), here.cuts)[2].tolist() == [0, 0]


def test_forgotten_pieces_are_learned_again():
    model = unigram_model()
    here, there = Backend(model), Backend(model)
    here.store.limit = 2
    texts = ["the other hand", "a  the   and ", " there\nand z", "the other"]
    assert [here.encode_batch([t])[0] for t in texts] == there.encode_batch(texts)


def test_sentencepiece_empty(spark):
    assert encode_documents(empty(spark)).count() == 0


# language model


def brute_katz(rows, train):
    words = lambda t: [*(t or "").encode().lower().split(), b" "]
    uni, pair = Counter(), Counter()
    for (i, t), use in zip(rows, train):
        if use:
            w = words(t)
            uni.update(w)
            pair.update(zip([b"", *w], w))
    n, v = sum(uni.values()), len(uni)
    ranks = Counter(pair.values())
    d = discounts([ranks[r] for r in range(1, 7)])
    after = defaultdict(dict)
    for (h, w), c in pair.items():
        after[h][w] = c
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)

    def given_history(h):
        """Probabilities of the words seen behind h, and the weight of all others."""
        seen = after[h]
        total = sum(seen.values())
        kept = {w: (d[c - 1] if c <= 5 else 1.0) * c for w, c in seen.items()}
        total = total if sum(kept.values()) < total - 1e-12 else total + 1
        probs = {w: x / total for w, x in kept.items()}
        return probs, (1 - sum(probs.values())) / (1 - sum(map(p1, seen)))

    out = []
    for i, t in rows:
        w, score = words(t), 0.0
        for h, x in zip([b"", *w], w):
            if h in after:
                probs, weight = given_history(h)
                score += math.log10(probs[x] if x in probs else weight * p1(x))
            else:
                score += math.log10(p1(x))
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    for h in list(after)[:20]:
        probs, weight = given_history(h)
        rest = sum(p1(w) for w in uni if w not in probs) + 1 / (n + v + 1)
        assert sum(probs.values()) + weight * rest == pytest.approx(1)
    return out


@pytest.mark.parametrize("chunk", [2_000, 12_000_000])
def test_katz_beside_brute_force(spark, monkeypatch, chunk):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "a", "b", "é", f"w{rng.randrange(60)}"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "the"), (503, "the"), (504, "unseen words " * 300), (505, "x" * 4000)]
    monkeypatch.setattr("tablecheck.llm.katz.CHUNK_BYTES", chunk)
    got = katz_scores(docs(spark, rows), F.col("doc_id") % 3 != 0).toPandas()
    want = brute_katz(rows, [i % 3 != 0 for i, _ in rows])
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(got[columns].itertuples(index=False, name=None))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_katz_edges(spark):
    assert katz_scores(empty(spark), F.col("doc_id") % 7 != 2).count() == 0
    got = katz_scores(docs(spark, [(None, "a b"), (2, "a")]), F.lit(False)).toPandas()
    assert got.held_out.all() and got.score.tolist() == [0, 0] and sorted(got.n_tokens) == [2, 3]


def test_discounts():
    assert discounts([100, 40, 22, 15, 11, 8]) == pytest.approx([(2 * 40 / 100 - 0.48) / 0.52, (3 * 22 / 80 - 0.48) / 0.52, (4 * 15 / 66 - 0.48) / 0.52, (5 * 11 / 60 - 0.48) / 0.52, (6 * 8 / 55 - 0.48) / 0.52])
    assert discounts([0, 0, 0, 0, 0, 0]).tolist() == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_packed_arrays():
    for x in ([], [3], [0, 255], [256, 1], [2**40, 5]):
        assert from_sized(sized(np.array(x, np.int64))).tolist() == x
    x = np.random.default_rng(1).random(9)
    assert (from_planes(planes(x), "<f8") == x).all()

"""Cuts against the library and against all cuts."""

from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tests.llm import cases
from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a  b", "  lead", "trail ", "日本語 テキスト ☃🙂x", "tab\tnl\n\nx", "<s> </s> <unk> <0x0A>", "\0z", " ", "x" * 50]


@pytest.mark.parametrize("memo", [100, 50_000_000])
def test_ids_are_those_of_the_library(spark, memo):
    with open(PATH, "rb") as source:
        own = pieces.Pieces(source.read(), memo)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in MORE + [r.text for r in cases.known(spark).limit(150).collect()] + cases.TEXTS[:16]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "")
        assert own.decode(ids) == (text or "") == library.decode(library.encode(text or ""))


def unigram(scores, byte_fallback):
    model = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256 * byte_fallback))]:
        model.pieces.add(piece=piece, score=score, type=kind)
    for piece, score in scores.items():
        model.pieces.add(piece=piece, score=score)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, byte_fallback
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    return model.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_scores_against_all_cuts(byte_fallback):
    scores = {"▁": -3.0, "a": -2.5, "b": -2.25, "ab": -3.5, "▁a": -4.0, "ba": -4.75, "aba": -6.0, "▁ab": -5.25, "bab▁": -7.0}
    model = unigram(scores, byte_fallback)
    own, library = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in map("".join, itertools.product("abé ", repeat=5)):
        text_ids = np.frombuffer(own.encode(text), "<u4").tolist()
        full = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e9] * len(full)
        for end in range(1, len(full) + 1):
            for start in range(end):
                s = scores.get(full[start:end], own.worst if end - start == 1 else -1e9)
                best[end] = max(best[end], best[start] + s)
        assert sum(own.scores[k] if own.spelling[k] in scores else 0 for k in text_ids) + own.worst * text.count("é") == best[-1]
        if "é" not in text or byte_fallback:
            assert own.decode(own.encode(text)) == text
        assert text_ids == library.encode(text)


def test_rows(spark):
    docs = cases.documents(spark)
    encoded = pieces.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == docs.count()
    again = {(r.doc_id, r.text) for r in pieces.decode(encoded, PATH).collect()}
    assert again == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert all(r.same for r in pieces.round_trip(docs, PATH).collect())
    assert pieces.round_trip(docs.limit(0), PATH).collect() == []


def test_a_text_without_blanks_takes_memory_in_proportion():
    own = pieces.pieces(PATH)
    draw = random.Random(1)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz日本語\U0001f600", k=120_000))
    expected = own.encode(text[:3000])
    tracemalloc.start()
    ids = own.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.decode(ids) == text and peak < 120 * len(text)  # pairs remembered included, which are bounded
    assert own.decode(expected) == text[:3000]


def test_a_pair_is_judged_once(monkeypatch):
    with open(PATH, "rb") as source:
        own = pieces.Pieces(source.read())
    judged = []
    plain = pieces.Pieces.beside
    monkeypatch.setattr(pieces.Pieces, "beside", lambda self, left, right: judged.append((left, right)) or plain(self, left, right))
    words = ["▁unhappinesses", "▁日本x", "xyzzyplughabc"]
    cuts = [own.cut(w) for w in words]
    assert judged and len(judged) == len(set(judged)) == len(own._beside)
    assert [own.cut(w) for w in words] == cuts and len(judged) == len(set(judged))


def test_merges_of_equal_score_go_from_the_left():
    model = sentencepiece_model_pb2.ModelProto()
    for piece, score in [("a", 0.0), ("b", 0.0), ("aa", -1.0), ("ab", -2.0), ("aab", -3.0)]:
        model.pieces.add(piece=piece, score=score)
    model.trainer_spec.model_type = 2
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    own = pieces.Pieces(model.SerializeToString())
    assert own.merged("aaab") == ["aa", "ab"] and own.merged("aab") == ["aab"] and own.merged("") == []

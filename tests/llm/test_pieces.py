import random

import sentencepiece
from pyspark.sql import functions as F

from kindred.llm import pieces


def test_ids_are_those_of_the_library():
    own = pieces.pieces(pieces.model_file())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    rng = random.Random(9)
    parts = ["the ", "Quick", " internationalisation", "2024 ", "3.14", "naïve ", "中文", "한국", "😀", "aaaa", "  ", "\n", "\t", "()", "\x00", "▁", "ﬁ", "�", "e", "s", "t "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdefst hein") for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", " ", "a" * 2000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == text.replace("▁", " ")
    own.forget()
    assert own.encode(["the same again"])[0].tolist() == library.encode("the same again")


def test_the_plain_way_agrees():
    own = pieces.pieces(pieces.model_file())
    for text in ("internationalisation", "aaaaaaa", "中x", "the"):
        assert own.encode([text])[0].tolist() == own.plainly("▁" + text)


def test_frames(hard, nothing):
    ids = pieces.encode(hard)
    back = pieces.decode(ids)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in hard.collect()), key=str)
    trip = pieces.round_trip(hard)
    assert trip.filter("not restored").count() == 0
    assert trip.agg(F.sum("n_pieces")).first()[0] == ids.agg(F.sum(F.size("ids"))).first()[0]
    assert pieces.round_trip(nothing).count() == 0 and pieces.encode(nothing).count() == 0

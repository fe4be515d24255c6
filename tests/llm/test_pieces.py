from __future__ import annotations

import numpy as np
import pytest
import sentencepiece

from cutpoint.llm.pieces import Encoder, encode, fields
from cutpoint.llm.queries import PIECE_MODEL, tokenizer

TEXTS = [
    "",
    " ",
    "  a  b ",
    "▁x▁▁ y",
    "日本語テスト😀😀 \n\n x\t\ty",
    "<s> </s> <unk> <0x41>",
    "é ﬁ ① ａｂｃ　x",
    "\x00a\x00b",
    "x" * 300,
    "word " * 3000,
    "a­b​c  ",
]


def model_with(rule: str | None) -> bytes:
    """The public model, with the normaliser of a built-in rule."""
    with open(tokenizer(PIECE_MODEL), "rb") as file:
        model = file.read()
    if rule is None:
        return model
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return b"".join(raw for n, _, raw in fields(model) if n != 3) + b"".join(raw for n, _, raw in fields(normal) if n == 3)


def expected(library, text: str):
    out = []
    for number, value, _ in fields(library.encode(text, out_type="serialized_proto")):
        if number == 2:
            piece = {n: v for n, v, _ in fields(value)}
            out.append((piece[2], piece.get(4, 0), piece.get(5, 0)))
    return out


@pytest.mark.parametrize("rule", [None, "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_ids_and_spans_are_the_librarys(rule):
    model = model_with(rule)
    made, library = Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in TEXTS:
        got = [tuple(map(int, t)) for t in zip(*made.encode(text))]
        assert got == expected(library, text), (rule, text[:40])


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("cutpoint.llm.pieces.REMEMBERED", 8)
    monkeypatch.setattr("cutpoint.llm.pieces.STRETCH", 64)
    made = Encoder(model_with(None))
    for text in TEXTS * 2:
        assert made.encode(text)[0].tolist() == made.library.encode(text)


def test_rows(odd, odd_rows):
    got = encode(odd, tokenizer(PIECE_MODEL)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_MODEL))
    assert len(got) == len(odd_rows)
    by_text = {r["text"]: r for r in got}
    for row in odd_rows:
        found, text = by_text[row[1]], row[1] or ""
        ids = [1, *library.encode(text), 2]
        assert np.frombuffer(found["ids"], "<u4").tolist() == ids
        assert found["decoded"] == library.decode(ids) == text.replace("▁", " ")
        assert len(found["starts"]) == len(found["ends"]) == 4 * len(ids)
    # The clashing column gave way, the others stayed.
    assert [c.lower() for c in got[0].asDict()].count("ids") == 1 and "Stats" in got[0].asDict()


def test_no_rows(empty):
    assert encode(empty, tokenizer(PIECE_MODEL)).count() == 0

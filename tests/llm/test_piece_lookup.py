"""Pieces that are looked up in arrays give the ids of whole texts, and words met before cost no call for each."""

from __future__ import annotations

import random

import pytest

from mediaflow.llm import encoding
from mediaflow.llm.queries import tokenizer_path

SIGNS = [
    "a", "b", "the", " ", "  ", "\n", "\n\n", ".", ",", "é", "ß", " ", "　", " ", "\u0085", "日本", "😀", "1", "23",
    "'s", "\t", "\x00", "\x1c", " a", " the", "a word that is long", "longwordlongwordlongword", "ÿ", "à", "_", "’",
]


@pytest.fixture
def loaded():
    return encoding.PieceEncoder(tokenizer_path())


@pytest.mark.parametrize("kept, run", [(1_000_000, 1 << 18), (40, 7)])
def test_ids_are_those_of_whole_texts(loaded, monkeypatch, kept, run):
    monkeypatch.setattr(encoding, "KEPT_PIECES", kept)
    monkeypatch.setattr(encoding, "RUN", run)
    draw = random.Random(5)
    for trial in range(150):
        texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 40))) for _ in range(draw.randint(0, 5))] + [""]
        if trial % 40 == 0:
            texts.insert(0, "x <|endoftext|> y")
        whole = [one.ids for one in loaded._tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids, counts, _ = loaded.encode(texts)
        assert counts.tolist() == [len(one) for one in whole]
        assert ids.tolist() == [number for one in whole for number in one]


def test_known_words_reach_no_call(loaded, monkeypatch):
    texts = ["The first words, then more.\nOther words and the first ones again"] * 3
    first = loaded.encode(texts)[0].tolist()
    for name in ("_places", "_words", "_from_tokenizer"):
        monkeypatch.setattr(loaded, name, lambda *args: pytest.fail("a known word was looked up alone"))
    assert loaded.encode(texts[::-1])[0].tolist() == first


def test_short_pieces_are_told_apart_by_size_and_every_byte():
    kept = encoding._KeptPieces()
    names = [b"a", b"a\0", b"a\0\0", b"", *[bytes(8) + bytes([i]) for i in range(4)], b"x" * 15, b"x" * 14 + b"y"]
    raw = b"".join(names) + bytes(16)
    sizes = encoding.np.array([len(name) for name in names])
    starts = encoding.np.cumsum(sizes) - sizes
    low, high = encoding._short_keys(encoding.np.frombuffer(raw, "u1"), starts, sizes)
    real = sizes > 0
    assert len({*zip(low.tolist(), high.tolist())}) == len(names) and (high[real] != 0).all()
    low, high = low[real], high[real]
    ids = encoding.np.arange(real.sum(), dtype="u4")
    kept.add_pieces(ids >= 0, low, high, [name for name in names if name], ids, ids * 0 + 1, ids * 0 + 1)
    assert kept.find(low[::-1], high[::-1]).tolist() == ids[::-1].tolist()
    assert kept.find(low + encoding.np.uint64(1), high).tolist().count(-1) >= real.sum() - 4

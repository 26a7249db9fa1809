"""Byte repeats where rows of the table repeat, and what the encoder does with other tokenizers."""

from __future__ import annotations

import random

import numpy as np
import pytest

from mediaflow.llm import repeats, winnow
from mediaflow.llm.encoding import PieceEncoder, cuts_are_safe, encoder
from mediaflow.llm.queries import tokenizer_path


def kept_by_hand(rows):
    """Kept bytes by (id, text); equal rows are one document, in order of id."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(set(rows)):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = True
            seen.add(window)
        out[key, text] = bytes(byte for byte, lost in zip(data, gone) if not lost)
    return out


def words(draw, n):
    return " ".join(f"w{draw.randrange(10**7)}" for _ in range(n))


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_that_repeat_are_no_copies_of_themselves(spark, parts):
    draw = random.Random(9)
    passage = words(draw, 60)
    rows = [(1, passage), (1, passage), (2, f"before it {passage} after it")]
    # Passages in common, inside rows that stand there once to four times, and text that repeats within itself.
    shared = [words(draw, 40) for _ in range(6)]
    for i in range(3, 60):
        text = " ".join([words(draw, draw.randrange(30)), draw.choice(shared), words(draw, draw.randrange(30)), draw.choice(shared)])
        rows += [(i, text + passage * (i % 9 == 0))] * draw.choice([1, 1, 2, 4])
    rows += [(70, shared[0] * 3), (70, shared[0] * 3), (71, "short"), (71, "short"), (72, "ab" * 300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    wanted = kept_by_hand(rows)
    found = repeats.without_repeats(frame).collect()
    assert len(found) == len(rows)
    assert sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in found) == sorted(
        (key, len(text.encode()), wanted[key, text]) for key, text in rows
    )


def test_windows_that_nothing_shares_are_left_out():
    draw = random.Random(3)
    alike = words(draw, 30).encode()
    group = [alike + words(draw, 20).encode(), words(draw, 50).encode(), words(draw, 20).encode() + alike]
    both = repeats._Stretches([group, [alike, alike[:120]]])
    marks = np.split(both.shared(), both.first[1:])
    assert [m.any() for m in marks[:3]] == [True, False, True]
    assert marks[0].sum() == len(alike) - 99 and marks[4].all()
    found = repeats.repeated_windows([group], [[False] * 3])[0]
    assert found[2].sum() == len(alike) - 99 and not found[0].any()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    texts = ["the cat sat", "", "on  the\nmat the cat"]
    whole = Tokenizer(models.WordLevel({"[U]": 0, "the": 1, "cat": 2, "the cat sat": 3}, unk_token="[U]"))
    spaced = Tokenizer(models.WordLevel({"[U]": 0, "the": 1, "cat": 2}, unk_token="[U]"))
    spaced.pre_tokenizer = pre_tokenizers.Whitespace()
    folded = Tokenizer.from_file(tokenizer_path())
    folded.normalizer = normalizers.Replace("the cat", "dog")
    for i, tokenizer in enumerate((whole, spaced, folded)):
        path = str(tmp_path / f"{i}.json")
        tokenizer.save(path)
        assert not cuts_are_safe(tokenizer)
        ids, counts, spans = PieceEncoder(path, offsets=True).encode(texts)
        encoded = [tokenizer.encode(text, add_special_tokens=False) for text in texts]
        assert ids.tolist() == [one for e in encoded for one in e.ids] and counts.tolist() == [len(e.ids) for e in encoded]
        assert spans.tolist() == [list(span) for e in encoded for span in e.offsets]
    assert cuts_are_safe(Tokenizer.from_file(tokenizer_path()))


def test_idle_workers_forget_what_they_encoded(monkeypatch):
    from time import sleep

    from mediaflow.llm import encoding

    monkeypatch.setattr(encoding, "IDLE_SECONDS", 0.3)
    with encoder(tokenizer_path()) as loaded:
        loaded.encode(["some words to keep for a while"])
        old = [level[1] for level in loaded._levels]
    # The next task finds the young generations; the wait of the one before does not end its work.
    with encoder(tokenizer_path()) as again:
        assert again is loaded and all(level[0].place for level in loaded._levels)
        assert not any(level[1] in old for level in loaded._levels)
        sleep(0.6)
        assert all(level[0].place for level in loaded._levels)
        first = again.encode(["some words to keep for a while"])[0].tolist()
    sleep(0.6)
    assert not any(kept.place for level in loaded._levels for kept in level)
    with encoder(tokenizer_path()) as again:
        assert again.encode(["some words to keep for a while"])[0].tolist() == first


@pytest.mark.parametrize("limit", [1 << 24, 60, 1])
def test_items_of_one_id_are_listed_once(spark, monkeypatch, limit):
    draw = random.Random(4)
    texts = [words(draw, 14) for _ in range(4)]
    items = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (7, "one two"), (7, "three")]
    docs = [(1, f"{texts[0]} and {texts[1]} then one two three"), (2, texts[2]), (3, texts[3]), (1, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(winnow, "BLOCK_BYTES", limit)
    found = winnow.searched(documents, benchmark).withColumn("n", winnow.covered_words()).collect()
    assert sorted(((r["doc_id"], r["n"], r["items"]) for r in found), key=repr) == sorted(
        [(1, 31, ["5", "7"]), (2, 14, [""]), (3, 0, []), (1, 0, [])], key=repr
    )

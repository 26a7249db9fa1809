"""Language distances and fingerprints, computed plainly."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from mediaflow.llm import imatch, language


def grams_by_hand(text):
    low = text.lower()
    if not any(c.isalpha() for c in low):
        return []
    signs = re.sub("\x01+", "\x01", "\x01" + "".join(c if c.isalpha() else "\x01" for c in low) + "\x01")
    out = [c for c in signs if c != "\x01"]
    return out + [signs[i : i + n] for n in (2, 3) for i in range(len(signs) - n + 1)]


def code(gram):
    number = 0
    for c in gram:
        number = number << 21 | ord(c)
    return number


def nearest_by_hand(text, profiles):
    counts = Counter(grams_by_hand(text or ""))
    if not counts or not profiles:
        return "und", 0.0
    top = sorted(counts, key=lambda g: (-counts[g], code(g)))[:300]
    mean = {n: sum(i for i, g in enumerate(top) if counts[g] == n) / sum(counts[g] == n for g in top) for n in {counts[g] for g in top}}
    best = None
    for lang in sorted(profiles):
        ranks = profiles[lang]
        distance = sum(min(abs(ranks[g] - mean[counts[g]]), 300) if g in ranks else 300 for g in top)
        if best is None or distance < best[1]:
            best = lang, distance
    return best[0], 1 - best[1] / (300 * len(top))


def test_distances_are_those_of_plain_ranks(spark):
    draw = random.Random(6)
    letters = {"aa": "abcdefg ", "bb": "efghijkl  ", "cc": "αβγabé "}
    rows = []
    for i in range(90):
        lang = draw.choice(list(letters))
        rows.append((i, "".join(draw.choice(letters[lang]) for _ in range(draw.choice([3, 60, 4000]))), lang))
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 3!", "cc"), (103, "xyz", None), (104, "x" * 50_000, "dd"), (105, "ŒÆ İ", None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3)
    counts: dict[str, Counter] = {}
    for _, text, lang in rows:
        if lang is not None and text is not None and grams_by_hand(text):
            counts.setdefault(lang, Counter()).update(grams_by_hand(text))
    profiles = {
        lang: {g: i for i, g in enumerate(sorted(n, key=lambda g: (-n[g], code(g)))[:300])} for lang, n in counts.items()
    }
    learned = language.learned(frame, "text", "lang")
    assert {lang: keys.tolist() for lang, keys in learned.items()} == {lang: [code(g) for g in ranks] for lang, ranks in profiles.items()}
    for row in language.identified(frame, "text", learned).collect():
        lang, score = nearest_by_hand(row["text"], profiles)
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(score, abs=1e-12)


def term_hash(term):
    seed = xxhash.xxh64(b"lexicon", seed=42).intdigest()
    value = xxhash.xxh64(term.encode(), seed=seed).intdigest()
    return value - (1 << 64) if value >> 63 else value


def print_by_hand(text, outside):
    terms = list(dict.fromkeys(t for t in re.split(r"[\W_]+", text.lower()) if t))
    level = max(math.ceil(math.log2(max(len(terms), 1) / 32)), 0)

    def at(chosen, n):
        return [t for t in chosen if term_hash(t) % 2**n == 0]

    chosen = [t for t in at(terms, level) if t not in outside] or at(terms, level)

    def hashed(n):
        if not chosen:
            all_of_it = " ".join(sorted(terms, key=str.encode)) if terms else text
            return ["00" + hashlib.sha1(all_of_it.encode()).hexdigest()[:16]] if text else []
        subsets: dict[int, list[str]] = {}
        for t in at(chosen, n):
            subsets.setdefault((term_hash(t) >> 32) % 32, []).append(t)
        return [f"{s:02d}" + hashlib.sha1(" ".join(sorted(ts, key=str.encode)).encode()).hexdigest()[:6] for s, ts in sorted(subsets.items())]

    low, high = hashed(level), hashed(level + 1)
    return f"{level}:{','.join(low)}:{','.join(high)}" if low or high else ""


def test_fingerprints_are_those_of_plain_hashes(spark):
    draw = random.Random(8)
    outside = ["the", "of", "and"]
    texts = [" ".join(draw.choice(["the", "of", "And", f"w{draw.randrange(500)}", f"Ünï{draw.randrange(90)},"]) for _ in range(n)) for n in (1, 2, 3, 10, 31, 64, 65, 129, 2000, 9000)]
    texts += ["", " .,! ", "the of and", "THE", "a b the", "日本 語"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    found = frame.select("text", imatch.as_text(imatch.fingerprint(F.col("text"), lambda term: ~term.isin(outside))).alias("p"))
    assert {r["text"]: r["p"] for r in found.collect()} == {text: print_by_hand(text, outside) for text in texts}

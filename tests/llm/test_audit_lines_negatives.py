"""Source divergence, line dedup and hard negatives against plain Python, on odd input too."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaflow.llm import divergence, lines, negatives


def small(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- source divergence


def audit_by_hand(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    found = defaultdict(Counter)
    docs = defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small(text or ""))
        found[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for l, s in found if l == lang)

        def shares(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + len(kept)) for t in kept}

        p = {s: shares(found[lang, s]) for s in sources}
        q = shares(sum((found[lang, s] for s in sources), Counter()))

        def ranked(source, part, values, limit=None):
            order = sorted(values.items(), key=lambda item: (-item[1], item[0].encode()))[:limit]
            out.extend((lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(order))

        for s in sources:
            ranked(s, "pair", {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in sources if o != s})
            own = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if found[lang, s][t] and p[s][t] > q[t]}
            ranked(s, "term", own, top)
    return sorted(out)


@pytest.fixture
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Straße", "ÉCOLE", "日本", "the"]
    rows = []
    for i in range(300):
        size = rng.choice([0, 1, 5, 40, 400])
        text = " ".join(rng.choice(vocabulary[: rng.choice([5, 50, 404])]) for _ in range(size)) + " the THE the" * (i % 3)
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "日"])))
    rows += [(None, "fr", "x"), ("1 2 3", "fr", "y"), ("once", "it", "x"), ("", "it", "y"), ("one alone", "pt", None)]
    return rows + rows[:9]


def test_audit_is_that_of_plain_counts(spark, corpus):
    frame = spark.createDataFrame([(i, *row, 1) for i, row in enumerate(corpus)], "doc_id int, text string, lang string, source string, n int")
    wanted = audit_by_hand(corpus)
    for parts in (1, 6):
        assert sorted(map(tuple, divergence.audited(frame.repartition(parts)).collect())) == wanted
    few = sorted(map(tuple, divergence.audited(frame, min_documents=1, top_terms=2).collect()))
    assert few == audit_by_hand(corpus, 1, 2)
    assert divergence.audited(frame.limit(0)).count() == 0


def test_counts_are_sent_on_when_many_are_held(spark, corpus, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    monkeypatch.setattr(divergence, "COUNT_BYTES", 300)
    names = ("text", "lang", "source")
    batches = [pa.record_batch([pa.array([r[i] for r in corpus[at : at + 40]], pa.string()) for i in range(3)], names) for at in range(0, len(corpus), 40)]
    total: Counter = Counter()
    rows = 0
    for batch in divergence._count_terms(iter(batches)):
        for row in batch.to_pylist():
            rows += 1
            if row["term"] is not None:
                total[row["lang"], row["source"], row["term"]] += row["n"]
    wanted: Counter = Counter()
    for text, lang, source in corpus:
        wanted.update((lang or "", source or "", t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small(text or "")))
    assert total == wanted and rows > len(wanted)


def test_cells_of_a_word_may_be_cut(monkeypatch):
    rng = np.random.default_rng(1)
    code = np.repeat(np.arange(4), 9)
    count = np.tile(np.arange(9), 4)
    bits = np.where(count, np.uint64(1) << rng.permutation(36).astype(np.uint64), np.uint64((1 << 36) - 1))
    p = rng.integers(1, 10**9, 36)
    names, whole = divergence._word_cells(code, p, count, bits.copy())
    monkeypatch.setattr(divergence, "CELLS", 8)
    assert np.array_equal(divergence._word_cells(code, p, count, bits.copy())[1], whole)
    p_of = np.array([[next((p[i] for i in range(36) if code[i] == s and count[i] and bits[i] >> np.uint64(t) & np.uint64(1)), p[9 * s]) for t in range(36)] for s in range(4)])
    assert names.tolist() == [0, 1, 2, 3]
    assert whole.tolist() == [[sum((int(x) - int(y)) ** 2 // int(y) for x, y in zip(a, b)) for b in p_of] for a in p_of]


# --- line dedup


def lines_by_hand(rows, chars=20, least=3):
    """(id, n_lines, n_dropped, kept) of rows (id, text)."""
    holders = defaultdict(set)
    split = [[(line, small(line.strip(" \t\n\x0b\x0c\r"))) for line in (text or "").split("\n")] for _, text in rows]
    for (key, _), parts in zip(rows, split):
        for _, name in parts:
            if len(name) >= chars:
                holders[name].add(key)
    keeper = {name: max((k for k in keys if k is not None), default=None) for name, keys in holders.items() if len(keys) >= least}
    out = []
    for (key, _), parts in zip(rows, split):
        kept = [line for line, name in parts if name not in keeper or keeper[name] == key]
        out.append((key, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_are_those_of_plain_sets(spark):
    rng = random.Random(5)
    pool = [f"A line of text with the number {i:03d}" for i in range(60)] + [f"kürzer Ä {i} éàü Öß çñ ÀÉ" for i in range(20)] + ["short", "", "  ", "19 characters here.", "20 characters here.."]
    hot = "\t The SAME line in every third document \r"
    rows = []
    for i in range(240):
        body = [rng.choice(pool) + rng.choice(["", " ", "\r", "\x0b"]) for _ in range(rng.choice([1, 3, 200]))]
        body += [hot] * (i % 3 == 0) + [hot.strip()] * (i % 6 == 0)
        rows.append((i if i % 17 else None, "\n".join(body)))
    rows += rows[:20] + [(500, None), (501, ""), (502, "\n"), (7, pool[0] + "\n" + pool[1]), (7, pool[2] + "\n")]
    frame = spark.createDataFrame([(*row, "x", i) for i, row in enumerate(rows)], "doc_id bigint, text string, kept string, n_lines int")
    for parts in (1, 7):
        dealt = frame.repartition(parts)
        found = lines.without_lines(dealt, lines.keep_bitmaps(dealt))
        assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
        got = found.select("doc_id", "n_lines", "n_dropped", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == lines_by_hand(rows)
    none = frame.limit(0)
    assert lines.without_lines(none, lines.keep_bitmaps(none)).count() == 0


def test_bitmaps_are_sparse_and_exact(spark):
    common = "this line is in all of the documents"
    long = "\n".join([common] + [f"line number {i} of the long one" for i in range(1000)] + [common])
    rows = [(1, long), (2, common), (3, common), (4, f"{common}\nmy own line, and only mine")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    bitmaps = {r["id"]: r for r in lines.keep_bitmaps(frame).collect()}
    assert set(bitmaps) == {1, 2, 3}
    assert [(w["word"], w["bits"]) for w in bitmaps[1]["keep"]] == [(0, -2), (15, ~(1 << (1001 % 64)))]
    assert bitmaps[1]["n_dropped"] == 2
    cleaned = {r["doc_id"]: r["kept"] for r in lines.without_lines(frame, lines.keep_bitmaps(frame)).collect()}
    assert cleaned == {1: long.removeprefix(common + "\n").removesuffix("\n" + common), 2: "", 3: "", 4: rows[3][1]}


def test_line_dedup_runs_no_python(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = lines.without_lines(frame, lines.keep_bitmaps(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- hard negatives


def negatives_by_hand(rows, positives=5, count=10, scale=256):
    """rows (id, label, vector); the rows that take part."""
    usable = []
    for key, label, vector in rows:
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(scale * float(np.float64(x)))) for x in vector]
        if sum(x * x for x in whole) < 2**62:
            usable.append((key, label, whole))
    out = []
    for key, label, vector in usable:
        if key % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v)), k, l) for k, l, v in usable]
        for score, positive, _ in sorted(r for r in scored if r[2] == label and r[1] != key)[:positives]:
            able = sorted((s, k) for s, k, l in scored if l != label and 30 * -score <= 100 * -s <= 90 * -score)
            out += [(key, positive, i + 1, k, -score, -s) for i, (s, k) in enumerate(able[:count])]
    return sorted(out)


SCHEMA = "vec_id bigint, label int, embedding array<double>, rank int, score int"


def found_by(spark, rows, **options):
    frame = spark.createDataFrame([(*row, 1, 1) for row in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(frame, F.col("id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("size", [0.5, 3e4, 9e5])
def test_negatives_are_those_of_plain_scores(spark, size):
    rng = np.random.default_rng(7)
    base = rng.normal(0, size, (12, 24))
    rows = [(i, int(rng.integers(0, 4)), (base[i % 12] + rng.normal(0, size / 2, 24)).tolist()) for i in range(450)]
    # One vector held by a third of the rows, ties, ids that repeat, and rows that take no part.
    rows += [(1000 + i, i % 3, base[0].tolist()) for i in range(220)] + rows[95:105]
    rows += [(5000, None, base[1].tolist()), (5001, 1, None), (5002, 1, [None] * 24), (5003, 1, [float("nan")] * 24), (None, 1, base[1].tolist())]
    rows += [(5004, 1, [float("-inf")] * 24), (5005, 1, [1e300] * 24), (5006, 2, [1.0]), (5007, 2, []), (5100, 2, [1.0, size])]
    assert found_by(spark, rows) == negatives_by_hand(rows)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(20 * i, i % 5, rng.normal(0, 1, 8).tolist()) for i in range(400)]
    wanted = negatives_by_hand(rows, 3, 4)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    assert found_by(spark, rows, positives=3, negatives=4) == wanted
    assert found_by(spark, []) == [] and found_by(spark, [(0, 1, [1.0])]) == []
    assert found_by(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


@pytest.mark.parametrize("bits", [6, 20, 30])
def test_residue_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(-(1 << bits), 1 << bits, (n, 1500)) for n in (7, 5))
    a[0], b[0] = 1 << bits, -(1 << bits)
    if bits == 30:
        a, b = a[:, :3], b[:, :3]
    primes = negatives.prime_moduli(float(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max())) * 1.001)
    assert np.array_equal(negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes), a @ b.T)


def test_window_bounds_are_exact():
    scores = np.array([0, 1, 9, 10, 11, 99, 10**6 + 7, 2**61 + 3, -1, -10])
    low, high = negatives.window_bounds(scores, (3, 10), (9, 10))
    for s, a, b in zip(scores.tolist(), low.tolist(), high.tolist()):
        assert a == -(-3 * s // 10) and b == 9 * s // 10

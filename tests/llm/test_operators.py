"""Each operator on odd input: NULLs, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaflow.llm import (
    attribution,
    binary,
    boilerplate,
    chat,
    graph,
    imatch,
    language,
    minhash,
    mixing,
    repeats,
    winnow,
)
from mediaflow.llm.common import scratch
from mediaflow.llm.encoding import PieceEncoder
from mediaflow.llm.markup import ARTICLE, FURNITURE, OPEN, blocks
from mediaflow.llm.queries import VOCABULARY, tokenizer_path
from mediaflow.llm.runindex import RunIndex


# --- HTML extraction


def test_blocks_are_told_apart_by_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
    <main><article><h1>Head &amp; line</h1><p>One <b>bold<p>Two<br>lines &nbsp; here<script>var a="</p>"</script>
    <aside>Side</aside><form>Name <input></form><section id="comments"><article class="comment">Nice!</article></section>
    <div class="no-sidebar">Three</div><!-- hidden > --></article></main><footer>Foot</footer>"""
    found = blocks(page)
    assert [b.text for b in found if b.kind == ARTICLE] == ["Head & line", "One bold", "Two lines here", "Three"]
    assert {b.text for b in found if b.kind == FURNITURE} == {"Site", "Menu", "We use cookies", "Side", "Name", "Nice!", "Foot"}
    assert [b.text for b in blocks("<div>a<p>b</div>c < d")] == ["a", "b", "c < d"]
    assert blocks("<div hidden>x</div>")[0].kind == FURNITURE and blocks("x")[0].kind == OPEN
    assert blocks("<script>never closed") == [] and blocks("") == []


def test_what_a_host_repeats_is_no_text(spark):
    note = "please accept our terms of use before you read any further on this site"
    rows = [(i, f"http://h.example/{i}", f"<div>own{i} words{i} of{i} page{i}</div><div>{note} p{i}</div><div>Home</div>") for i in range(4)]
    rows += [(10, "http://other.example/", f"<div>{note}</div>"), (11, None, None), (12, "", ""), (13, "http://h.example/", "<article>whole</article>")]
    rows += [(14, "http://z.example/", "<div>same page twice</div>")] * 4 + [(None, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    found = sorted((r["page_id"] is None, r["page_id"], r["text"]) for r in boilerplate.main_text(pages).filter("page_id is not null").collect())
    texts = [(key, text) for _, key, text in found]
    assert texts[:4] == [(i, f"own{i} words{i} of{i} page{i}\n\np{i}") for i in range(4)]
    assert texts[4:8] == [(10, note), (11, ""), (12, ""), (13, "whole")]
    assert texts[8:] == [(14, "same page twice")] * 4
    assert boilerplate.main_text(pages.limit(0)).count() == 0


# --- mixing


def test_mix_meets_targets_and_limits(spark, odd_documents, no_documents):
    copies = mixing.mixed(odd_documents, "doc_id", "source", mixing.words(F.col("text")))
    rows = copies.collect()
    assert sum(1 for r in rows if r["epoch"] == 0) == odd_documents.count()
    taken: dict = {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["taken"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[r["source"]] - r["target"]) <= largest for r in rows)
    assert all(r["target"] <= 3 * r["source_size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(odd_documents.repartition(7), "doc_id", "source", mixing.words(F.col("text"))).collect()))
    assert mixing.mixed(no_documents, "doc_id", "source", mixing.words(F.col("text"))).count() == 0
    whole = mixing.mixture(odd_documents, "doc_id", "source", "text")
    assert whole.columns == odd_documents.columns
    assert whole.count() == sum(r["taken"] for r in rows)


def test_targets_share_out_what_a_source_cannot_take(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 10), ("c", 980)], "source string, size bigint")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sized, (1, 2, 3), 3).collect()}
    assert found == {"a": 30.0, "b": 30.0, "c": 940.0}


# --- language


def test_language_on_odd_texts(spark, odd_documents, no_documents):
    profiles = language.learned(odd_documents, "text", "lang")
    assert sorted(profiles) == ["de", "en"] and all(len(p) <= language.PROFILE for p in profiles.values())
    told = language.identified(odd_documents, "text", profiles)
    assert sorted(told.columns) == sorted({*odd_documents.columns, "lang_pred"})
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in told.collect()]
    assert len(found) == odd_documents.count()
    assert {key for key, lang, _ in found if lang == "und"} == {2, 3, 4, 5}
    assert all(score == 0 for _, lang, score in found if lang == "und")
    assert [lang for key, lang, _ in found if key == 8] == ["de", "de"]
    nothing = language.identified(odd_documents, "text", language.learned(no_documents, "text", "lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.identified(no_documents, "text", profiles).count() == 0


# --- tokens


@pytest.mark.parametrize("offsets", [False, True])
def test_encoder_gives_the_tokenizers_ids(offsets):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    draw = random.Random(5)
    signs = "ab \n\t's.,é 　!1 \r\x1c日\U0001f600 "
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(30))) for _ in range(1500)]
    texts += ["", "a<|endoftext|>b <|endoftext|> c", "It's  they'll\n\nwe've "]
    ours = PieceEncoder(tokenizer_path(), offsets)
    for _ in range(2):
        ids, counts, spans = ours.encode(texts)
        ends = np.cumsum(counts)
        for text, end, n, theirs in zip(texts, ends, counts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[end - n : end].tolist() == theirs.ids, text
            if offsets:
                assert [tuple(span) for span in spans[end - n : end].tolist()] == theirs.offsets


def test_encoder_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr("mediaflow.llm.encoding.KEPT", 3)
    ours = PieceEncoder(tokenizer_path())
    texts = [f"alpha beta{i} gamma{i % 3}. delta" for i in range(12)]
    one_by_one = [ours.encode([text])[0].tolist() for text in texts]
    assert one_by_one == [PieceEncoder(tokenizer_path()).encode([text])[0].tolist() for text in texts]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packed_ids_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** min(bits, 31), 1003).astype(np.uint32)
    payload = binary.pack(ids, bits)
    assert len(payload) == (1003 * bits + 7) // 8
    for first, stop in ((0, 1003), (0, 0), (501, 502), (17, 940)):
        assert binary.unpack(payload, bits, first, stop).tolist() == ids[first:stop].tolist()


def test_packing_refuses_large_ids_and_width_is_least():
    with pytest.raises(ValueError):
        binary.pack(np.array([8], np.uint32), 3)
    assert [binary.width(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_token_files_of_odd_documents(spark, odd_documents, no_documents):
    path = scratch(spark, "odd")
    binary.write_tokens(odd_documents, path, tokenizer_path(), VOCABULARY, "doc_id", "text")
    rows = binary.read_tokens(spark, path).collect()
    assert len(rows) == odd_documents.count()
    assert min((r["start"], r["doc_id"]) for r in rows)[1] is None
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    ids = binary.document_ids(spark.read.parquet(path), 10)
    assert ids.tolist() == [*PieceEncoder(tokenizer_path()).encode(["the"])[0].tolist(), 0]
    empty = scratch(spark, "none")
    binary.write_tokens(no_documents, empty, tokenizer_path(), VOCABULARY, "doc_id", "text")
    assert binary.read_tokens(spark, empty).count() == 0


def test_crossing_tokens_follow_the_rule(spark, odd_documents, no_documents):
    spans = np.array([[0, 3], [3, 8], [8, 9]])
    bounds = np.array([0, 4, 5, 9])
    assert attribution.shared_out(spans, bounds, "start")[0].tolist() == [2, 0, 1]
    assert attribution.shared_out(spans, bounds, "majority")[0].tolist() == [1, 0, 2]
    counts, crossing = attribution.shared_out(spans, bounds, "split")
    assert counts.round(6).tolist() == [1.2, 0.2, 1.6] and crossing == 1
    found = attribution.attributed(odd_documents, "doc_id", ["source", "text"], tokenizer_path())
    rows = found.collect()
    assert len(rows) == 2 * odd_documents.count()
    assert {r["n_tokens"] for r in rows if r["id"] == 2 and r["field"] == "source"} == {1.0}
    assert attribution.attributed(no_documents, "doc_id", ["text"], tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        attribution.attributed(odd_documents, "doc_id", ["text"], tokenizer_path(), rule="none")


# --- repeats


def naive_matches(parts, pattern):
    for t in range(len(pattern)):
        size = 0
        while t + size < len(pattern) and any(p[k : k + size + 1] == pattern[t : t + size + 1] for p in parts for k in range(len(p) - size)):
            size += 1
        yield size


def test_matching_statistics_are_those_of_brute_force():
    draw = random.Random(3)
    for _ in range(40):
        letters = draw.choice((1, 2, 4, 20))
        parts = [[draw.randrange(1, letters + 1) for _ in range(draw.randrange(1, 40))] for _ in range(draw.randrange(1, 5))]
        text = [symbol for part in parts for symbol in (*part, 0)]
        patterns = [[draw.randrange(1, letters + 2) for _ in range(draw.randrange(0, 25))] for _ in range(4)] + [parts[0][1:]]
        bounds = np.cumsum([0, *map(len, patterns)])
        found = RunIndex(np.array(text)).matching_statistics(np.array([s for p in patterns for s in p], np.int64), bounds)
        for pattern, begin in zip(patterns, bounds):
            assert found[begin : begin + len(pattern)].tolist() == list(naive_matches(parts, pattern))


def test_repeats_across_and_within_documents(spark, no_documents):
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(180))
    other = "".join(draw.choice("abcdefgh ") for _ in range(130))
    texts = [f"x{i}{passage[: 180 - 3 * i]}y{i}{other if i % 3 else ''}z{i}" for i in range(25)]
    texts += ["ab" * 150, "q" * 99, "ab" * 60, "é" * 120, "", None, texts[3], passage + "!" + passage]
    rows = [(i, text) for i, text in enumerate(texts)]
    found = {r["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    seen: set[bytes] = set()
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        assert found[key]["kept"] == bytes(b for b, out in zip(data, gone) if not out), key
        assert sum(s["stop"] - s["start"] for s in found[key]["spans"]) == gone.sum()
    assert repeats.without_repeats(no_documents).count() == 0


def test_repeats_of_odd_documents(odd_documents):
    rows = repeats.without_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r["doc_id"]: len(r["kept"]) for r in rows}[7] == 0


# --- decontamination


def test_winnowing_finds_every_window(spark, odd_documents, no_documents, monkeypatch):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    item_words = [[draw.choice(words) for _ in range(n)] for n in (0, 1, 3, 9, 10, 11, 25, 25)]
    items = [(i, " ".join(w).upper()) for i, w in enumerate(item_words)] + [(90, None), (None, "w3, w4! w5")]
    texts = []
    for i in range(30):
        own = [draw.choice(words) for _ in range(40)]
        source = draw.choice(item_words)
        texts.append((i, ", ".join(own[:20] + source[draw.randrange(3) :] + own[20:])))
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def wanted():
        import re

        split = lambda text: re.findall("[0-9a-z]+", (text or "").lower())
        for key, text in texts:
            own, hit, found = split(text), set(), set()
            for name, item in items:
                parts = split(item)
                width = min(10, len(parts))
                windows = {tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)} if width else set()
                for i in range(len(own) - width + 1):
                    if tuple(own[i : i + width]) in windows:
                        hit |= set(range(i, i + width))
                        found.add("" if name is None else str(name))
            yield key, len(own), len(hit), sorted(found)

    for limit in (winnow.BLOCK_BYTES, 40):
        monkeypatch.setattr(winnow, "BLOCK_BYTES", limit)
        rows = winnow.searched(documents, benchmark).withColumn("n", winnow.covered_words()).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n"], sorted(r["items"])) for r in rows) == sorted(wanted())
        odd = winnow.searched(odd_documents, benchmark)
        assert odd.count() == odd_documents.count() and "h" in odd.columns
        assert winnow.searched(no_documents, benchmark).count() == 0
    clean = winnow.searched(documents, benchmark.limit(0))
    assert clean.filter(F.size("items") > 0).count() == 0 and clean.count() == 30


# --- near-duplicates


def naive_components(rows, similarity=80):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())

    sets = [(key, shingles(text)) for key, text in rows]
    label = {key: key for key, _ in sets}
    for a, one in sets:
        for b, two in sets:
            if one and two and 100 * len(one & two) >= similarity * len(one | two):
                low, high = sorted((label[a], label[b]))
                label = {key: low if value == high else value for key, value in label.items()}
    return label


def test_near_duplicates_are_those_of_all_pairs(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(8):
        base = [draw.choice(words) for _ in range(draw.choice((4, 30, 90)))]
        for _ in range(14):
            text = list(base)
            for _ in range(draw.randrange(0, 9)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(500 + i, "one") for i in range(3)] + [(510, "One"), (511, "two words"), (512, ""), (513, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    wanted = naive_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in found)


def test_near_duplicates_of_odd_documents(odd_documents, no_documents):
    rows = minhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert found[7] == (6, False) and found[6] == (6, True) and found[None] == (None, True)
    assert found[2] == (2, True) and [r["component_id"] for r in rows if r["doc_id"] == 9] == [9, 9]
    assert minhash.near_duplicates(no_documents).count() == 0


def test_crowd_keeps_its_links_where_rows_repeat(spark):
    # 89 shingles of all and 11 of each one's own: any two have 89 of 111 in common, and no rare one.
    base = " ".join(f"base{i}" for i in range(90))
    rows = [(i, f"{base} " + " ".join(f"own{i}x{k}" for k in range(11))) for i in range(40)]
    rows += [(i, text.upper()) for i, text in rows] + rows + [(i, f"another{i} text{i} of{i} this{i} id{i}") for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    crowd = (
        minhash._signed(documents, 2)
        .filter("n_shingles = 100")
        .select(F.lit(1).cast("bigint").alias("band"), F.col("doc_id").alias("rep"), F.col("doc_id").alias("component"),
                "k0", "k1", F.col("n_shingles").alias("n"), "s0", "s1", F.lit(40).alias("members"))
        .distinct()
    )
    assert crowd.count() == 40
    found = {(r["a"], r["b"]) for r in minhash._across(crowd, documents, 80, 2).collect()}
    assert found == {(a, b) for a in range(40) for b in range(a)}


def test_sketches_turn_away_fewer_pairs_than_buckets_miss():
    from math import comb

    limit = minhash.sketch_limit(80)
    lost = sum(comb(128, k) * 0.1**k * 0.9 ** (128 - k) for k in range(limit + 1, 129))
    assert lost < 1e-8 < (1 - 0.8**6) ** 48


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}


# --- chat


def test_formatted_turns_come_back(spark):
    rows = [
        (1, 2, "assistant", "b \\h# ### x"), (1, 1, "user", "a: ### user: </turn> \\l/turn> \\"), (1, 3, "assistant", None),
        (1, 3, "assistant", None), (1, None, "sys:tem", "first"), (2, 0, None, "no role"), (2, 1, "assistant", "####\\\\"),
        (None, 0, "user", ""), (3, 0, "assistant", "日本\U0001f600 </turn"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    found = {r["conv_id"]: r for r in chat.formatted(turns).withColumn("back", chat.parsed(F.col("formatted"))).collect()}
    assert len(found) == 4
    for key, row in found.items():
        own = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: (r[0] is not None, r[0], r[1] or "", r[2] or ""))
        assert [(t["role"], t["text"]) for t in row["back"]] == [(role or "", text or "") for _, role, text in own]
        assert row["loss_mask"] == [role == "assistant" for _, role, _ in own]
        pieces = [row["formatted"][s["start"] : s["start"] + s["chars"]] for s in row["loss_spans"]]
        ours = [(t["text"]).replace("\\", "\\\\").replace("##", "\\h#").replace("</turn>", "\\l/turn>") for t in row["back"] if t["role"] == "assistant"]
        assert pieces == ours
    assert found[1]["formatted"].count("### assistant: ") == 1
    assert chat.formatted(turns.limit(0)).count() == 0


# --- fingerprints


def test_fingerprints_of_odd_documents(spark, odd_documents, no_documents):
    in_band = imatch.band(odd_documents, "text", common=0.5)
    pairs = imatch.edited_pairs(odd_documents, "doc_id", "text", in_band)
    rows = pairs.select("doc_id", imatch.as_text(F.col("print")).alias("p"), imatch.likeness(F.col("print"), F.col("edited_print")).alias("near")).collect()
    # The row repeated in full is one document.
    assert len(rows) == odd_documents.count() - 1
    prints = {r["doc_id"]: r["p"] for r in rows}
    assert prints[6] == prints[7] != "" and prints[2] == prints[3] == ""
    assert all(0 <= r["near"] <= 1 for r in rows)
    assert imatch.edited_pairs(no_documents, "doc_id", "text", imatch.band(no_documents, "text")).count() == 0
    banded = imatch.band(odd_documents, "text", common=0.5, rare=0.1)
    assert odd_documents.select(imatch.fingerprint(F.col("text"), banded)["level"]).count() == odd_documents.count()


def prints_of(spark, rows):
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    pairs = imatch.edited_pairs(documents, "doc_id", "text", imatch.band(documents, "text"))
    near = imatch.likeness(F.col("print"), F.col("edited_print")).alias("near")
    after = imatch.likeness(F.col("print"), F.col("next_print")).alias("after")
    return {r["doc_id"]: r for r in pairs.select("doc_id", imatch.as_text(F.col("print")).alias("p"), near, after).collect()}


def test_a_large_group_of_copies_keeps_its_fingerprint(spark):
    draw = random.Random(2)
    text = lambda i: " ".join(f"the of and t{i}x{draw.randrange(10**6)}" for _ in range(60))
    copied = text(0)
    found = prints_of(spark, [(i, copied if i % 3 == 0 else text(i)) for i in range(60)])
    assert len({found[i]["p"] for i in range(0, 60, 3)}) == 1 and found[0]["p"] != ""
    assert len({row["p"] for row in found.values()}) == 41
    assert all(row["near"] > row["after"] for row in found.values())
    assert np.mean([row["near"] for row in found.values()]) > 0.3 and np.mean([row["after"] for row in found.values()]) < 0.05


def test_small_tables_and_common_words_are_told_apart(spark):
    texts = [" ".join(f"a{i}w{k}" for k in range(60)) for i in range(3)]
    found = prints_of(spark, list(enumerate(texts)))
    assert len({row["p"] for row in found.values()}) == 3 and all(row["p"] for row in found.values())
    assert all(row["near"] > 0 and row["after"] == 0 for row in found.values())
    # Every word is in many texts; signs alone have no word.
    common = ["this", "the", "this the", "the end", "this end", "...", "!!", "", None]
    found = prints_of(spark, [*enumerate(common), *((i, f"this the end own{i}") for i in range(20, 40))])
    assert len({found[i]["p"] for i in range(7)}) == 7 and found[7]["p"] == found[8]["p"] == ""


def test_likeness_follows_the_terms_in_common(spark):
    draw = random.Random(8)
    words = [f"term{i}" for i in range(5000)]
    base = [draw.choice(words) for _ in range(200)]
    texts = [" ".join(base), " ".join(base[:190] + words[:10]), " ".join(base[:100] + words[:100]), " ".join(draw.choice(words) for _ in range(200))]
    df = spark.createDataFrame([tuple(texts)], "a string, b string, c string, d string")
    print_ = {name: imatch.fingerprint(F.col(name), lambda term: F.lit(True)) for name in "abcd"}
    near = df.select(*[imatch.likeness(print_["a"], print_[name]).alias(name) for name in "abcd"]).first()
    assert near["a"] == 1.0 and near["b"] > 0.6 and near["b"] > near["c"] > near["d"] and near["d"] < 0.2

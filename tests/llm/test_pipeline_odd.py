"""Every stage of the pipeline on NULLs, empty and very long texts, ties, repeated rows, extra columns and empty tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture
def mixed_documents(spark, odd_documents):
    """The odd rows among real ones, with columns named like the operators' own."""
    real = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    extra = {name: F.lit("x") for name in ("size", "items", "score", "hits", "component", "n_words", "finish")}
    odd = odd_documents.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))
    odd = odd.withColumn("doc_id", F.col("doc_id") + 10**6)
    long = odd.filter(f"doc_id = {10**6 + 6}").withColumn("text", F.concat_ws(" ", *["text"] * 12)).withColumn("doc_id", F.lit(2 * 10**6))
    return real.unionByName(odd).unionByName(long).withColumns(extra).repartition(4)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, mixed_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = corpus_pipeline.stored(mixed_documents, "odd")
    out = stage(spark, rows, FOLDER)
    found = out.collect()
    keys = [r["doc_id"] for r in rows.collect()]
    if name == "token files":
        # Each row in order, NULL ids first; every document has its end id.
        assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == sorted(keys, key=lambda k: (k is not None, k))
        assert min(r["n_tokens"] for r in found) == 1
    else:
        assert out.columns == rows.columns
        assert {r["doc_id"] for r in found} <= set(keys) and len(found) > 30
        assert all(r["items"] == "x" and r["score"] == "x" for r in found)
    empty = stage(spark, corpus_pipeline.stored(mixed_documents.limit(0), "none"), FOLDER)
    assert empty.count() == 0 and empty.columns == out.columns


def test_near_duplicate_stage_keeps_texts_that_share_an_id(spark):
    rows = [(1, "one text under an id", "en", "s", 1), (1, "quite another text of that id", "en", "s", 1), (1, "one text under an id", "en", "a", 1)]
    rows += [(2, "one text under an id", "en", "s", 1), (None, "one text under an id", "en", "s", 1), (None, None, None, None, None), (3, None, "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for parts in (1, 4):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), FOLDER).collect()
        assert sorted(map(tuple, kept), key=repr) == sorted([rows[2], rows[1], rows[4], rows[5], rows[6], rows[8]], key=repr)


def test_language_stage_drops_what_has_no_letter(spark, mixed_documents):
    kept = corpus_pipeline.identify_language(spark, mixed_documents, FOLDER).collect()
    assert all(any(c.isalpha() for c in r["text"] or "") for r in kept)
    assert {10**6 + 1, 10**6 + 8} <= {r["doc_id"] for r in kept}


def test_decontamination_stage_drops_hits_only(spark, mixed_documents):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    hit = mixed_documents.limit(1).withColumn("text", F.lit(f"before {item} after")).withColumn("doc_id", F.lit(77 * 10**6))
    kept = corpus_pipeline.decontaminate(spark, mixed_documents.unionByName(hit), FOLDER).select("doc_id").collect()
    assert 77 * 10**6 not in {r["doc_id"] for r in kept}
    assert {10**6 + i for i in (1, 2, 3, 4, 5, 6, 9, 11)} <= {r["doc_id"] for r in kept}


def test_mixing_stage_takes_no_row_over_three_times(spark, mixed_documents):
    rows = mixed_documents.collect()
    taken = corpus_pipeline.mix_sources(spark, mixed_documents, FOLDER).collect()
    for key in {r["doc_id"] for r in taken}:
        assert sum(r["doc_id"] == key for r in taken) <= 3 * sum(r["doc_id"] == key for r in rows)

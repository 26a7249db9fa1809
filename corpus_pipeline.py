"""From raw documents to packed token ids, stage by stage. Each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaflow.llm import binary, language, minhash, mixing, winnow
from mediaflow.llm.common import free_name, read, scratch, stored
from mediaflow.llm.queries import VOCABULARY, tokenizer_path

SHINGLE_WORDS = 5


def apart(docs: DataFrame, results: Iterable[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage that adds columns of these names, run so that the documents' own columns of that name stay what they are."""
    added = {name.lower() for name in results}
    aside = {name: free_name(docs, f"_{name}") for name in docs.columns if name.lower() in added}
    kept = stage(docs.withColumnsRenamed(aside)).select(*[aside.get(name, name) for name in docs.columns])
    return kept.toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter and those too far from every profile go."""
    training = docs.filter(~language.held_out("doc_id"))
    profiles = language.learned(training, "text", "lang")
    lowest = language.lowest_scores(training, "text", "lang", profiles)
    return apart(
        docs,
        ("lang_pred", "score"),
        lambda ours: language.identified(ours, "text", profiles).filter(language.believed(lowest)),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Rows that share an id are one document to the grouping; of these, rows with one text stay once, the first by all
    columns, and different texts all stay. Rows without an id stay.
    """
    dropped = minhash.near_duplicates(docs, width=SHINGLE_WORDS).filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    alike = Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy(*docs.columns)
    ours = left.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    once = ours.withColumn("__nth", F.row_number().over(alike)).filter("__nth = 1").drop("__nth")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    benchmark = read(spark, sf_dir, "benchmark")
    return apart(docs, winnow.RESULTS, lambda ours: winnow.searched(ours, benchmark).filter(F.size("items") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs, "doc_id", "source", "text")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the packed files, read back from them."""
    path = scratch(spark, "corpus")
    binary.write_tokens(docs, path, tokenizer_path(), VOCABULARY, "doc_id", "text")
    return binary.read_tokens(spark, path)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", write_token_files),
]

# Language ID and tokenising have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

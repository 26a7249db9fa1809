"""Language identification by rank-order profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (1 to 3 letters, a word's edge counting as a
sign) over all its training texts, by rank. A document's own most frequent n-grams are compared with each profile:
the out-of-place distance adds up by how many places each is off, ``PROFILE`` if the profile lacks it. The nearest
language wins, equal ones by name. The score is 1 - distance / greatest possible distance.

N-grams of all training texts are counted (summed in tasks, then by Spark); only the profiles, languages times
``PROFILE`` rows, go to the driver and into the tasks.

The nearest language is always named, however far it is. ``lowest_scores`` says from which score on to believe it: two
fifths of the median score of the training texts told to be in that language. Letters that no training text had score
0. A language close to a learned one in letters and endings may still pass.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
learned; n-grams of equal frequency share the mean of their ranks in a document and go by code in a profile;
repeated rows count as often as they stand there. Other columns stay; one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import extended
from mediaflow.llm.encoding import text_groups
from mediaflow.shipping import ship_package

PROFILE = 300
# Distinct n-grams a task holds before it passes its counts on.
HELD_GRAMS = 1_000_000
UNKNOWN = "und"
# A text is taken to be in its nearest language from this share of that language's median training score on.
BELIEVED = 0.4
# The median is taken over scores rounded down to one in so many, so that only counts reach the driver.
SCORE_STEPS = 1000
RESULTS = ("lang_pred", "score")
_EDGE = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The text's n-grams as numbers: 21 bits a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    # One edge for each run of other characters, and one at both ends.
    signs = np.concatenate([[_EDGE], np.where(is_letter, codes, _EDGE), [_EDGE]]).astype(np.int64)
    signs = signs[np.append(True, (signs[1:] != _EDGE) | (signs[:-1] != _EDGE))]
    pairs = signs[:-1] << 21 | signs[1:]
    return np.concatenate([signs[signs != _EDGE], pairs, pairs[:-1] << 21 | signs[2:]])


def learned(training: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """Profiles by language: n-grams, the most frequent first."""
    ship_package(training.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def emitted():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"]
                )
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in text_groups(batch.column(1).to_pylist()):
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(langs[first:], texts):
                    by_lang.setdefault(lang, []).append(grams(text))
                for lang, arrays in by_lang.items():
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(np.concatenate(arrays), return_counts=True))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_GRAMS:
                yield from emitted()
        yield from emitted()

    counted = (
        training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # languages times PROFILE rows
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(keys, np.int64) for lang, keys in profiles.items()}


class Nearest:
    """The out-of-place distance to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.keys = np.unique(np.concatenate([profiles[lang] for lang in self.langs])) if profiles else np.zeros(0, np.int64)
        # The last row stands for n-grams that no profile has.
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), np.inf)
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys = grams(text) if text and self.langs else ()
        if not len(keys):
            return UNKNOWN, 0.0
        keys, counts = np.unique(keys, return_counts=True)
        order = np.lexsort((keys, -counts))[:PROFILE]
        keys, counts = keys[order], counts[order]
        # Equal counts share the mean of their places.
        edge = np.flatnonzero(np.diff(counts)) + 1
        begin, end = np.append(0, edge), np.append(edge, len(counts))
        own = np.repeat((begin + end - 1) / 2, end - begin)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == keys, at, len(self.keys))
        places_off = np.minimum(np.abs(self.ranks[at] - own[:, None]), PROFILE)
        distance = places_off.sum(axis=0)
        nearest = int(np.argmin(distance))
        return self.langs[nearest], float(1 - distance[nearest] / (PROFILE * len(keys)))


def identified(documents: DataFrame, text_col: str, profiles: dict[str, np.ndarray]) -> DataFrame:
    """The documents with lang_pred and score."""
    ship_package(documents.sparkSession)
    kept = [name for name in documents.columns if name not in RESULTS]
    schema = extended(documents.schema, kept, "lang_pred string, score double")
    text_at = documents.columns.index(text_col)
    kept_at = [documents.columns.index(name) for name in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(profiles)
        for batch in batches:
            found = [nearest(text) for text in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in kept_at],
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                [*kept, *RESULTS],
            )

    return documents.mapInArrow(predict, schema)


def lowest_scores(training: DataFrame, text_col: str, lang_col: str, profiles: dict[str, np.ndarray]) -> dict[str, float]:
    """For each language told of a training text, the least score to believe it by; all training texts are scored."""
    texts = training.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"))
    steps = (
        identified(texts, "text", profiles)
        .filter(F.col("lang_pred") != UNKNOWN)
        .groupBy("lang_pred", F.floor(F.col("score") * SCORE_STEPS).alias("step"))
        .agg(F.count("*").alias("n"))
    )
    counts: dict[str, np.ndarray] = {}
    for row in steps.collect():  # languages times SCORE_STEPS rows at most
        counts.setdefault(row["lang_pred"], np.zeros(SCORE_STEPS + 1, np.int64))[row["step"]] = row["n"]
    medians = {lang: np.searchsorted(np.cumsum(n), (n.sum() + 1) // 2) / SCORE_STEPS for lang, n in counts.items()}
    return {lang: float(BELIEVED * median) for lang, median in medians.items()}


def believed(lowest: dict[str, float]) -> Column:
    """Whether lang_pred is believed; languages told of no training text go by the least of the other limits."""
    limit = F.lit(min(lowest.values(), default=0.0))
    for lang, least in lowest.items():
        limit = F.when(F.col("lang_pred") == lang, least).otherwise(limit)
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= limit)


def held_out(id_col: str) -> Column:
    """Documents that no profile may learn from: a third of them, by the checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1

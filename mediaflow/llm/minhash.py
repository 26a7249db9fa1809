"""Near-duplicates by circulant MinHash, confirmed by the exact Jaccard similarity.

Two permutations make all coordinates of a signature: the first deals the shingles out to the places of a circle,
the second gives each place a rank; coordinate k is the least rank after turning the circle by k places. So a
shingle's ranks for all coordinates are one contiguous slice of the second permutation.

1. Documents with the same shingle set become one class (summed up before the shuffle), named by its least id.
2. The bands of class signatures are hashed. In each bucket of equal bands, every class is paired with the
   bucket's least one: as many pairs as rows, however large the bucket.
3. Pairs whose sizes or sketches rule out the similarity go; for the rest both texts are fetched and the similarity
   is computed from the full sets. Confirmed links give components.
4. Buckets that still hold several components get another pivot, and at last what is left of them is paired across
   components, so that no link is lost that a bucket could show: within a component links add nothing. In a bucket
   with a crowd of classes, two classes either share a shingle that few classes of all crowds have, and meet by
   that, or share no more than their other shingles, and classes that these cannot make similar leave before the pairing.
   Crowds of copies that are not quite similar enough go this way.

With 48 bands of 6, a pair at similarity 0.8 is missed by all buckets once in two million times. The 128-bit
sketches turn away less than one in a hundred million such pairs.

Defined cases: a NULL or wordless text has the empty set and is linked with nothing; with fewer words than a
shingle has, the set is the run of all; rows that share an id are one document, linked by any of their texts, and each
gets its result; a NULL id gets a NULL component and stays. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import (
    NOT_SPACE,
    SHORT_PASS_BYTES,
    STEP,
    Bytes,
    PrefixHash,
    byte_passes,
    gram_hashes,
    lowered,
    mix,
    stored,
    word_spans,
)
from mediaflow.llm.graph import components
from mediaflow.shipping import ship_package

BANDS, ROWS = 48, 6
CIRCLE_BITS = 20
SKETCH_BITS = 128
# The share of pairs just at the similarity that the sketches may turn away, well under what the buckets miss.
SKETCH_LOSS = 1e-8
# Words in a shingle where the caller names no other width; a wider one tells texts with scattered edits apart.
WIDTH = 2
SEED = 11
PIVOT_ROUNDS = 1
# Classes in a bucket that are paired without a look at their own shingles; no pair depends on it.
CROWD = 8
# Of a crowd's classes, at most so many have a rare shingle; it only settles which way a pair is found.
RARE = 32


def shingle_sets(batch: Bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each row, the sorted hashes of its distinct shingles of ``width`` words."""
    data = lowered(batch.data)
    starts, ends, cuts = word_spans(Bytes(batch.first, data, batch.bounds), NOT_SPACE)
    words = PrefixHash(data).spans(starts, ends)
    shingles = gram_hashes(words, width)
    for begin, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if stop - begin >= width:
            yield np.unique(shingles[begin : stop - width + 1])
        elif stop > begin:
            value = words[begin : begin + 1]
            for word in words[begin + 1 : stop]:
                value = value * STEP + word
            yield mix(value + np.uint64(stop - begin))
        else:
            yield words[:0]


@lru_cache(maxsize=1)
def _ranks() -> np.ndarray:
    """Row i: the second permutation from place i on."""
    permutation = np.random.default_rng(SEED).permutation(1 << CIRCLE_BITS).astype(np.uint32)
    length = BANDS * ROWS
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([permutation, permutation[: length - 1]]), length)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    places = mix(shingles ^ np.uint64(SEED)) >> np.uint64(64 - CIRCLE_BITS)
    least = None
    for i in range(0, len(places), 2048):
        part = _ranks()[places[i : i + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def _digests(shingles: np.ndarray) -> tuple[int, int]:
    """What names a set that is not empty."""
    return int(np.bitwise_xor.reduce(shingles).view(np.int64)), int(mix(shingles + STEP).sum(dtype=np.uint64).view(np.int64))


def _signed(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, k0, k1, s0, s1, bands); the set's digest, its sketch and the hashes of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(BANDS, dtype=np.uint64) << np.uint64(40)
        for batch in batches:
            for texts in byte_passes(batch.column(1), SHORT_PASS_BYTES):
                sizes = np.zeros(len(texts), np.int64)
                keys = np.zeros((len(texts), 4), np.int64)
                bands = np.zeros((len(texts), BANDS), np.int64)
                for i, shingles in enumerate(shingle_sets(texts, width)):
                    sizes[i] = len(shingles)
                    if len(shingles):
                        coordinates = signature(shingles)
                        value = numbers.copy()
                        for column in coordinates.reshape(BANDS, ROWS).T:
                            value = value * STEP + column
                        bands[i] = mix(value).view(np.int64)
                        keys[i, :2] = _digests(shingles)
                        keys[i, 2:] = np.packbits((coordinates[:SKETCH_BITS] & 1).astype(bool)).view(np.int64)
                flat = pa.array(bands[sizes > 0].ravel())
                ends = np.append(0, np.cumsum(np.where(sizes > 0, BANDS, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(sizes),
                        *[pa.array(keys[:, i]) for i in range(4)],
                        pa.ListArray.from_arrays(pa.array(ends), flat),
                    ],
                    ["doc_id", "n_shingles", "k0", "k1", "s0", "s1", "bands"],
                )

    return documents.mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, k0 bigint, k1 bigint, s0 bigint, s1 bigint, bands array<bigint>"
    )


def _confirmed(pairs: DataFrame, documents: DataFrame, similarity: int, width: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets have at least ``similarity`` percent in common, from their texts."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.zeros(batch.num_rows, bool)
            ours = (s for texts in byte_passes(batch.column(2), SHORT_PASS_BYTES) for s in shingle_sets(texts, width))
            theirs = (s for texts in byte_passes(batch.column(3), SHORT_PASS_BYTES) for s in shingle_sets(texts, width))
            for i, (one, other) in enumerate(zip(ours, theirs)):
                both = len(np.intersect1d(one, other, assume_unique=True))
                links[i] = both > 0 and 100 * both >= similarity * (len(one) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(links))

    texts = documents.select("doc_id", "text")
    return (
        pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(confirm, "a bigint, b bigint")
    )


def _rare_shingles(reps: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """(rep, k0, k1, shingle, n): the shingles that at most ``RARE`` of these classes have, and how many n do.

    Rows that repeat, and texts with one set, count once; of an id with several texts, each set is a class.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in byte_passes(batch.column(1), SHORT_PASS_BYTES):
                sets = list(shingle_sets(texts, width))
                keys = np.array([_digests(one) if len(one) else (0, 0) for one in sets], np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                    ],
                    ["rep", "k0", "k1", "shingles"],
                )

    sets = stored(
        reps.join(documents.withColumnRenamed("doc_id", "rep"), "rep")
        .select("rep", "text")
        .mapInArrow(spread, "rep bigint, k0 bigint, k1 bigint, shingles array<bigint>")
        .dropDuplicates(["rep", "k0", "k1"]),
        "shingles",
    )
    shingles = sets.select("rep", "k0", "k1", F.explode("shingles").alias("shingle"))
    rare = shingles.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") <= RARE)
    return stored(shingles.join(rare, "shingle").select("rep", "k0", "k1", "shingle", "n"), "rare")


@lru_cache
def sketch_limit(similarity: int) -> int:
    """The most unlike bits of two sketches that still allow the similarity."""
    unlike, limit, tail = (100 - similarity) / 200, SKETCH_BITS, 0.0
    while limit > 0:
        tail += comb(SKETCH_BITS, limit) * unlike**limit * (1 - unlike) ** (SKETCH_BITS - limit)
        if tail >= SKETCH_LOSS:
            break
        limit -= 1
    return limit


def _possible(similarity: int):
    """What sizes and sketches of two classes allow: a size ratio, and few unlike bits of the sketches.

    Two classes at the similarity have each bit unlike with the chance (100 - similarity) / 200; the limit is the least
    number that the unlike bits, taken as independent, exceed less than ``SKETCH_LOSS`` of the time.
    """
    limit = sketch_limit(similarity)
    differing = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    return (
        (100 * F.col("x.n") >= similarity * F.col("y.n"))
        & (100 * F.col("y.n") >= similarity * F.col("x.n"))
        & (differing <= limit)
    )


def _to_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each class with one drawn from its bucket, where they are not in one component."""
    draw = F.xxhash64(F.lit(turn), "rep", "band")
    pivots = rows.groupBy("band").agg(F.min_by(F.struct("rep", "component"), draw).alias("pivot"))
    return (
        rows.join(pivots, "band")
        .filter(F.col("component") != F.col("pivot.component"))
        .select(F.greatest("rep", "pivot.rep").alias("a"), F.least("rep", "pivot.rep").alias("b"))
    )


def _with_larger(rows: DataFrame) -> DataFrame:
    """The rows of buckets with the larger buckets of their class, by members: fewest where a bucket has most rows."""
    before = Window.partitionBy("rep", "k0", "k1").orderBy(F.desc("members"), "band")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("larger", F.collect_list("band").over(before))


def _across(rows: DataFrame, documents: DataFrame, similarity: int, width: int) -> DataFrame:
    """Pairs of classes of one bucket and different components that may be similar enough."""
    # Of n and m shingles, o in common are enough if (100 + similarity) * o >= similarity * (n + m).
    apart = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.rep") > F.col("y.rep"))
        & ((100 + similarity) * F.least("x.most", "y.most") >= similarity * (F.col("x.n") + F.col("y.n")))
        & _possible(similarity)
    )
    few = rows.filter(F.col("members") <= CROWD).withColumn("most", F.col("n"))
    crowds = rows.filter(F.col("members") > CROWD)
    inside = crowds.select("rep", "k0", "k1", "component", "n", "s0", "s1").distinct()
    rare = _rare_shingles(inside.select("rep").distinct(), documents, width)
    # Either two classes have a rare shingle in common, or at most their other ones. The rarest that they share is then
    # among the first of both, as many as a set may have beyond what the similarity asks for, and one more. What sizes
    # and sketches rule out is never made a pair.
    rarest = Window.partitionBy("rep", "k0", "k1").orderBy("n", "shingle")
    placed = rare.withColumn("nth", F.row_number().over(rarest)).filter("n > 1").select("rep", "k0", "k1", "shingle", "nth")
    holders = placed.join(inside, ["rep", "k0", "k1"]).filter(100 * (F.col("nth") - 1) <= (100 - similarity) * F.col("n"))
    sharing = holders.alias("x").join(
        holders.alias("y"),
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.rep") > F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & _possible(similarity),
    )
    own = rare.groupBy("rep", "k0", "k1").agg(F.count("*").alias("own"))
    crowds = crowds.join(own, ["rep", "k0", "k1"], "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    least = crowds.groupBy("band").agg(F.min("n").alias("least"))
    able = crowds.join(least, "band").filter((100 + similarity) * F.col("most") >= similarity * (F.col("n") + F.col("least")))
    # Classes alike enough for one bucket share several: a pair is made in the largest of them only.
    able = _with_larger(able)
    once = ~F.arrays_overlap("x.larger", "y.larger")
    columns = ["band", "rep", "component", "n", "s0", "s1", "most"]
    found = [
        few.select(*columns).alias("x").join(few.select(*columns).alias("y"), apart),
        able.select(*columns, "larger").alias("x").join(able.select(*columns, "larger").alias("y"), apart & once),
    ]
    pairs = [pair.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")) for pair in (*found, sharing)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 80, width: int = WIDTH
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row, by shingles of ``width`` words; the least id of a
    component is kept."""
    ship_package(documents.sparkSession)
    documents = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(_signed(documents, width), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k0", "k1").agg(F.min("doc_id").alias("rep"))
    reps = stored(
        full.join(classes, ["k0", "k1"])
        .filter("doc_id = rep")
        .select("rep", "k0", "k1", F.col("n_shingles").alias("n"), "s0", "s1", "bands")
        .dropDuplicates(["rep", "k0", "k1"]),
        "classes",
    )
    facts = reps.select("rep", "k0", "k1", "n", "s0", "s1")
    rows = reps.select("rep", F.explode("bands").alias("band"))
    # Only buckets of several classes matter; most bands stand alone.
    shared = rows.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    buckets = stored(rows.join(shared, "band").select("band", "rep", "low"), "buckets")

    def tried(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that sizes and sketches allow."""
        return (
            pairs.join(facts.alias("x"), F.col("a") == F.col("x.rep"))
            .join(facts.alias("y"), F.col("b") == F.col("y.rep"))
            .filter(_possible(similarity))
            .select("a", "b")
        )

    # Rows that share an id are one document.
    same_id = (
        full.join(classes, ["k0", "k1"])
        .groupBy("doc_id")
        .agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
        .filter("a <> b")
        .select("a", "b")
    )
    first = buckets.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    pairs = stored(tried(first.distinct()), "pairs")
    labels = components(stored(_confirmed(pairs, documents, similarity, width).unionByName(same_id), "confirmed"))
    for turn in range(PIVOT_ROUNDS + 1):
        labelled = (
            buckets.drop("low")
            .join(labels, F.col("rep") == F.col("node"), "left")
            .select("band", "rep", F.coalesce("component", "rep").alias("component"))
        )
        several = (
            labelled.groupBy("band")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
            .filter("low <> high")
            .select("band", "members")
        )
        open_rows = labelled.join(several, "band")
        if turn < PIVOT_ROUNDS:
            new = tried(_to_pivots(open_rows, turn).distinct())
        else:
            new = tried(_across(stored(open_rows.join(facts, "rep"), "open"), documents, similarity, width).distinct())
        fresh = stored(new.join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            pairs = pairs.unionByName(fresh)
            # What is linked already is a star for each component; only what is new is more.
            stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            confirmed = stored(_confirmed(fresh, documents, similarity, width), "confirmed")
            labels = components(stars.unionByName(confirmed))
    out = (
        signed.select("doc_id", "n_shingles", "k0", "k1")
        .join(classes, ["k0", "k1"], "left")
        .join(labels, F.col("rep") == F.col("node"), "left")
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )

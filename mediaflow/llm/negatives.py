"""Hard negatives by exact integer scores, computed as matrix products in a residue number system.

Components are whole numbers. For a few primes below 256 both matrices are reduced to the residues nearest zero, which
float32 multiplies and adds without rounding while a sum stays below 2**24; from the residues of a score the Chinese
remainder theorem gives the signed score itself. The number of primes follows from the largest squared length among
the rows, which bounds every score (Cauchy and Schwarz), so scores are exact for any input.

Anchors are the stated query set. They are dealt into blocks of about ``BLOCK`` rows and the rows into slices; a task
holds one block and streams one slice past it, keeping the first few of each anchor. It takes two passes: the first
finds each anchor's positives, the second the negatives in the score window that each positive sets. What tasks have
kept is merged by window functions, at most a few rows for each anchor and task.

Defined cases: rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part, nor do rows
whose squared length is 2**62 or more, since their scores need not fit into a bigint. An empty vector is all zeros, and
of two vectors the shorter is filled up with zeros. Rows that share an id are rows of their own as anchors and as
negatives, but no row is a positive of an anchor with its id. Ties go by id. An anchor without positives, or a
positive without negatives in its window (a negative score's window is empty), gives no rows; nor does an empty table.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import stored
from mediaflow.shipping import ship_package

BLOCK = 4096
# Scores that are in memory at a time.
CELLS = 1 << 21
LONGEST = 2.0**62
ABSENT = np.iinfo(np.int64).min


def prime_moduli(bound: float) -> list[int]:
    """Primes below 256, largest first, whose product is over twice the bound."""
    primes, product = [], 1
    for n in range(255, 2, -2):
        if all(n % k for k in range(3, int(n**0.5) + 1, 2)):
            primes.append(n)
            product *= n
            if product > 2 * bound + 1:
                return primes
    raise ValueError(f"scores up to {bound} need more primes")


def balanced(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues nearest zero."""
    half = prime // 2
    return (values + half) % prime - half


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [balanced(matrix, prime).astype(np.float32) for prime in primes]


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact products of the rows of two matrices given by their residues."""
    total, product = None, 1
    for a, b, prime in zip(left, right, primes):
        step = (1 << 24) // (prime // 2) ** 2 - 1
        part = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], step):
            part += (a[:, at : at + step] @ b[:, at : at + step].T).astype(np.int64)
        if total is None:
            total = balanced(part, prime)
        else:
            # The next digit in base `product`; the sum may wrap on its way, the whole score fits.
            digit = balanced((part - total) % prime * pow(product, -1, prime), prime)
            total += digit * np.int64(product)
        product *= prime
        product = product if product < 1 << 63 else product - (1 << 64)
    return total


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one matrix, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def leading(values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``count`` largest entries of each row; of equal ones the leftmost. ABSENT is no entry."""
    width = values.shape[1]
    if width > count:
        least = np.partition(values, width - count, axis=1)[:, width - count, None]
        above, ties = values > least, values == least
        chosen = above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= count - above.sum(axis=1, keepdims=True)))
    else:
        chosen = np.ones(values.shape, bool)
    return np.nonzero(chosen & (values != ABSENT))


class Leaders:
    """The first ``count`` rows of each list met so far: by score, largest first, then by id."""

    def __init__(self, count: int):
        self.count = count
        self.lists, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """One row of scores for each list; the columns are in order of their ids."""
        row, column = leading(values, self.count)
        lists = np.concatenate([self.lists, row])
        found = np.concatenate([self.scores, values[row, column]])
        names = np.concatenate([self.ids, ids[column]])
        order = np.lexsort((names, -found, lists))
        lists = lists[order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = order[rank < self.count]
        self.lists, self.scores, self.ids = lists[rank < self.count], found[keep], names[keep]


class _Block:
    """The anchors of one task."""

    def __init__(self, table: pa.Table, width: int, primes: list[int]):
        self.numbers = table["anchor"].to_numpy()
        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        self.residues = residues(matrix(table["vector"].combine_chunks(), width), primes)
        self.positives = table["positives"].to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], width: int, primes: list[int]) -> Iterator[tuple]:
    """Anchors come first; then (block, ids, labels, scores) for runs of rows, in order of their ids."""
    held, block = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ours = table["anchor"].is_valid()
        held.append(table.filter(ours))
        rows = table.filter(pa.compute.invert(ours))
        if not len(rows):
            continue
        if block is None:
            block = _Block(pa.concat_tables(held), width, primes)
        if not len(block.numbers):
            continue
        rows = rows.take(pa.compute.sort_indices(rows["id"]))
        step = max(1, CELLS // len(block.numbers))
        for at in range(0, len(rows), step):
            part = rows.slice(at, step)
            other = residues(matrix(part["vector"].combine_chunks(), width), primes)
            yield block, part["id"].to_numpy(), part["label"].to_numpy(), scores(block.residues, other, primes)


def _find_positives(width: int, primes: list[int], count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = Leaders(count), None
        for block, ids, labels, found in _slices(batches, width, primes):
            able = (labels == block.labels[:, None]) & (ids != block.ids[:, None])
            best.add(np.where(able, found, ABSENT), ids)
        if block is not None:
            yield pa.record_batch(
                {"anchor": block.numbers[best.lists], "id": best.ids, "score": best.scores}
            )

    return run


def window_bounds(score: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole scores between two fractions (numerator, denominator) of a score."""

    def floor_of(value, fraction):
        whole, rest = np.divmod(value, fraction[1])
        return whole * fraction[0] + rest * fraction[0] // fraction[1]

    return -floor_of(-score, low), floor_of(score, high)


def _find_negatives(width: int, primes: list[int], count: int, low: tuple[int, int], high: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[Leaders] = []
        block = None
        for block, ids, labels, found in _slices(batches, width, primes):
            found = np.where(labels != block.labels[:, None], found, ABSENT)
            for slot in range(max(map(len, block.positives))):
                if slot == len(best):
                    best.append(Leaders(count))
                have = np.array([len(p) > slot for p in block.positives])
                score = np.array([p[slot]["score"] if len(p) > slot else -1 for p in block.positives], np.int64)
                least, most = window_bounds(score, low, high)
                able = have[:, None] & (found >= least[:, None]) & (found <= most[:, None])
                best[slot].add(np.where(able, found, ABSENT), ids)
        for slot, leaders in enumerate(best):
            chosen = [block.positives[i][slot] for i in leaders.lists]
            yield pa.record_batch(
                {
                    "anchor": block.numbers[leaders.lists],
                    "slot": np.full(len(chosen), slot, np.int32),
                    "anchor_id": block.ids[leaders.lists],
                    "positive_id": pa.array([p["id"] for p in chosen], pa.int64()),
                    "positive_score": pa.array([p["score"] for p in chosen], pa.int64()),
                    "negative_id": leaders.ids,
                    "negative_score": leaders.scores,
                }
            )

    return run


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(id, label, vector, norm2): rows that take part, components scaled and rounded down to whole numbers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    length = F.aggregate(
        vector_col,
        F.lit(0.0),
        lambda total, x: total + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)),
    )
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(
            F.col(id_col).cast("bigint").alias("id"),
            label.cast("bigint").alias("label"),
            whole.alias("vector"),
            length.alias("norm2"),
        )
        .filter(F.col("label").isNotNull() & (F.col("norm2") < LONGEST))
    )


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (3, 10),
    high: tuple[int, int] = (9, 10),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. An anchor's positives are the first rows of its label; negatives have other
    labels and a score between the two fractions of the positive's score.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, F.col("label") if label is None else label, vector_col, scale)
    size = rows.agg(
        F.max("norm2").alias("norm2"), F.max(F.size("vector")).alias("width"), F.sum(is_anchor.cast("bigint")).alias("n")
    ).first()
    width, count = size["width"] or 0, size["n"] or 0
    # The squared lengths are sums of doubles; the margin covers their rounding.
    primes = prime_moduli((size["norm2"] or 0.0) * 1.001 + 1)
    blocks = max(1, -(-count // BLOCK))
    slices = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    anchors = stored(
        rows.filter(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vector"),
        "anchors",
    ).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))

    def dealt(block_rows: DataFrame) -> DataFrame:
        """One partition for each block and slice; a block's anchors stand before its rows."""
        ours = block_rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        others = rows.select(
            F.lit(None).cast("bigint").alias("anchor"),
            "id",
            "label",
            "vector",
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
            F.lit(None).cast(block_rows.schema["positives"].dataType).alias("positives"),
            F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"),
        )
        cell = F.col("block") * slices + F.col("slice")
        both = ours.select(*others.columns).unionByName(others).withColumn("cell", cell.cast("int"))
        return (
            both.repartitionById(blocks * slices, "cell")
            .sortWithinPartitions(F.col("anchor").asc_nulls_last())
            .select("anchor", "id", "label", "vector", "positives")
        )

    pair = "struct<id:bigint,score:bigint>"
    near = dealt(anchors.withColumn("positives", F.lit(None).cast(f"array<{pair}>"))).mapInArrow(
        _find_positives(width, primes, positives), "anchor bigint, id bigint, score bigint"
    )
    first = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    chosen = (
        near.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= positives)
        .groupBy("anchor")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
        .select("anchor", F.transform("found", lambda p: F.struct(p["id"], p["score"])).cast(f"array<{pair}>").alias("positives"))
    )
    informed = stored(anchors.join(chosen, "anchor"), "anchors")
    found = dealt(informed).mapInArrow(
        _find_negatives(width, primes, negatives, low, high),
        "anchor bigint, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, "
        "negative_id bigint, negative_score bigint",
    )
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )

"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a flow that sends its documents in a seeded random order, up to ``max_repeats`` times over.
A copy's virtual finish time is the number of its source's tokens up to and with it, divided by the source's
target. Copies in order of finish time are the mix; it is cut where its running total would pass the budget.
So all sources run out of budget at the same virtual time and none is starved or bunched up.

Running totals come in two steps, over buckets and within them, so no window holds a whole source: a source
is cut by the first three digits of the order digest (4096 buckets), the mix by finish time (buckets of equal
width hold about equally many tokens, since every source sends at the rate of its target).

Targets: a source gets its weight's share of the budget, at most ``max_repeats`` times its size; what it cannot
take is shared among the others by weight until nobody is above. The budget is met within one document; a
source misses its target by about one document.

Defined cases: a NULL source is a source of its own and sorts last; a NULL or negative size counts as 0 and
takes 0; rows with equal ids are told apart by (source, size) and then by row number, so each repeated row is a
document of its own; an empty table gives an empty result. Weights follow the code point order of the sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import free_name

# Finish times below 1 are cut in so many buckets; later ones go on in the same width.
TIME_BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of runs without white space; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sorted by how soon the limit binds, the sources at their limit come first. The share of the first source
    that is not at its limit, given those before it are, is the share of all that follow.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.array(*[F.lit(int(weight)) for weight in weights])
    weighted = sources.withColumn("nth", F.row_number().over(by_name) - 1).select(
        "source",
        "source_size",
        F.get(deal, F.col("nth") % len(weights)).alias("weight"),
        (F.col("source_size") * max_repeats).alias("most"),
    )
    by_limit = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    shares = weighted.withColumn("share", left / F.sum("weight").over(onward))
    free = F.col("most") >= F.col("share") * F.col("weight")
    share = F.max(F.when(free, F.col("share"))).over(everything)
    return shares.select(
        "source",
        "source_size",
        F.least(F.col("most").cast("double"), F.coalesce(share * F.col("weight"), F.col("most"))).alias("target"),
    )


def mixed(
    documents: DataFrame,
    id_col: str,
    source_col: str,
    size: Column,
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 7,
) -> DataFrame:
    """Copies that the mix takes or leaves: (id, source, size, twin, source_size, target, epoch, digest, finish,
    position, taken); every document has its copy of epoch 0. Sorting the taken ones by ``position`` gives the mix.
    """
    sized = documents.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("size"),
    )
    targets = source_targets(sized, weights, max_repeats)
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    alike = Window.partitionBy("id").orderBy("source", "size")
    flows = (
        sized.withColumn("twin", F.row_number().over(alike))
        .join(F.broadcast(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")) + 1, F.lit(max_repeats)))
            .otherwise(1)
            .cast("int"),
        )
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn(
            "digest",
            F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("id").cast("string"), F.lit("")), "twin")),
        )
        .withColumn("bucket", F.substring("digest", 1, 3))
    )
    flow = ["source", "epoch", "bucket"]
    totals = flows.groupBy(*flow).agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(name).alias(f"of_{name}") for name in flow],
        F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"),
    )
    so_far = Window.partitionBy(*flow).orderBy("digest", F.col("id").asc_nulls_first(), "twin")
    same = [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in flow]
    finished = (
        flows.withColumn("within", F.sum("size").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(offsets, same)
        .withColumn("sent", F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("within"))
        .withColumn("finish", F.when(F.col("target") > 0, F.col("sent") / F.col("target")).otherwise(F.lit(0.0)))
        .withColumn("slot", F.floor(F.col("finish") * TIME_BUCKETS))
        .drop(*[f"of_{name}" for name in flow], "offset", "within", "sent", "epochs", "bucket")
    )
    slots = finished.groupBy(F.col("slot").alias("of_slot")).agg(F.sum("size").alias("slot_size"))
    passed = Window.orderBy("of_slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_offsets = slots.select("of_slot", F.coalesce(F.sum("slot_size").over(passed), F.lit(0)).alias("offset"))
    in_slot = Window.partitionBy("slot").orderBy(
        "finish", F.col("source").asc_nulls_last(), "epoch", "digest", F.col("id").asc_nulls_first(), "twin"
    )
    return (
        finished.withColumn("within", F.sum("size").over(in_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(slot_offsets, F.col("slot") == F.col("of_slot"))
        .crossJoin(F.broadcast(budget))
        .withColumn("position", F.col("offset") + F.col("within"))
        .withColumn("taken", F.col("position") <= F.col("budget"))
        .drop("slot", "of_slot", "offset", "within", "budget")
    )


def mixture(documents: DataFrame, id_col: str, source_col: str, text_col: str, **options) -> DataFrame:
    """The documents of the mix, all columns kept, each as often as the mix takes it."""
    size, twin, key, times = (free_name(documents, name) for name in ("mix_size", "mix_twin", "mix_id", "mix_times"))
    numbered = documents.withColumn(size, words(F.col(text_col)))
    alike = Window.partitionBy(id_col).orderBy(F.col(source_col).cast("string"), size)
    numbered = numbered.withColumn(twin, F.row_number().over(alike))
    taken = (
        mixed(documents, id_col, source_col, words(F.col(text_col)), **options)
        .groupBy(F.col("id").alias(key), F.col("twin").alias(f"_{twin}"))
        .agg(F.sum(F.col("taken").cast("int")).alias(times))
    )
    return (
        numbered.join(taken, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(twin) == F.col(f"_{twin}")))
        .filter(F.col(times) > 0)
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*documents.columns)
    )

"""Connected components of links in a table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import stored

# Links that one task takes, some 16 bytes each; more are dealt out to all.
FEW_LINKS = 1 << 17


def _pair(*links: tuple[str, str]):
    """A row (a, b) for each of these two ends."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in links]))


def _gathered(links: DataFrame, few: bool) -> DataFrame:
    return links.coalesce(1) if few else links


def _with_least(links: DataFrame, few: bool) -> DataFrame:
    """The links and m, the least b of their a. Few links sort in their one task; else no task gets all links of a node."""
    if few:
        return links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    return links.join(least, F.col("a") == F.col("u")).drop("u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Each round hangs the larger neighbours of every node on its least neighbour, then the smaller ones too. Links
    never grow in number, and all are stars after a number of rounds that grows with the logarithm of the nodes.
    A round is written to the shared folder. A round over at most ``FEW_LINKS`` links is one task's, which shuffles and
    broadcasts nothing; results do not depend on it. Links with a NULL end are dropped.
    """
    edges = stored(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    count = edges.count()
    while True:
        few = count <= FEW_LINKS
        both = _gathered(edges.select(_pair(("a", "b"), ("b", "a"))), few)
        large = (
            _with_least(both, few).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        )
        small = _with_least(large, few).select(_pair(("a", "m"), ("b", "m"))).filter("a <> b")
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state, count = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

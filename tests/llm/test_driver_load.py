"""What the driver has to plan, send and hold for near-duplicates and decontamination stays small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mediaflow.llm import common, graph, minhash
from tests.conftest import plan_of


def test_rounds_over_few_links_join_and_broadcast_nothing(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 30), (30, 40)], "a bigint, b bigint")
    plans = []
    stored = graph.stored

    def seen(df, name):
        plans.append(plan_of(df))
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", seen)
    found = {r["node"]: r["component"] for r in graph.components(links.repartition(3)).collect()}
    assert found == {**{i: 0 for i in range(10)}, 20: 20, 30: 20, 40: 20}
    # The first plan removes double links.
    assert len(plans) > 2 and not any("Join" in plan or "Broadcast" in plan for plan in plans[1:])


def test_rows_of_the_largest_bucket_carry_no_other_and_each_pair_is_made_once(spark):
    # Ten classes in bucket 5; the first three share bucket 1 too, the first two bucket 9.
    members = {5: 10, 1: 3, 9: 2}
    rows = [(rep, rep, rep, band, n) for band, n in members.items() for rep in range(n)]
    rows.append((0, 0, 0, 5, 10))  # a row that repeats
    rows = spark.createDataFrame(rows, "rep bigint, k0 bigint, k1 bigint, band bigint, members bigint")
    placed = minhash._with_larger(rows.repartition(4))
    carried = {(r["rep"], r["band"]): r["larger"] for r in placed.filter("rep > 0").collect()}
    assert all(carried[rep, 5] == [] for rep in range(1, 10))
    assert carried[1, 1] == carried[2, 1] == [5] and carried[1, 9] == [5, 1]
    pairs = placed.alias("x").join(
        placed.alias("y"),
        (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") > F.col("y.rep")) & ~F.arrays_overlap("x.larger", "y.larger"),
    )
    made = pairs.select("x.rep", "y.rep", "x.band").toDF("a", "b", "band").distinct().collect()
    assert sorted((r["a"], r["b"]) for r in made) == [(a, b) for a in range(10) for b in range(a)]
    assert {r["band"] for r in made} == {5}


def test_power_tables_grow_with_what_is_hashed(monkeypatch):
    monkeypatch.setattr(common, "_powers", {})
    data = np.arange(3000, dtype=np.int64).astype(np.uint8)
    small = common.PrefixHash(data).grams(10)
    assert sum(table.nbytes for table in common._powers.values()) < 200_000
    common.PrefixHash(np.zeros(common.PASS_BYTES, np.uint8))
    assert (common.PrefixHash(data).grams(10) == small).all()
    assert max(map(len, common._powers.values())) <= common.PASS_BYTES + 2

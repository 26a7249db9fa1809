"""Bloom prefilter, label numbers as tables, bucketed tables and merged statistics."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from mediaflow.operators import bloom, features, joins, labels, payload, tagging
from mediaflow.sources import tables
from tests.conftest import plan_of, rows_of


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- Bloom prefilter


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "date", "boolean"])
def test_prefilter_keeps_every_partner(spark, kind):
    def typed(column):
        number = F.col(column)
        return {"date": F.date_add(F.lit("2020-01-01"), number.cast("int")), "boolean": number % 2 == 0}.get(
            kind, number.cast(kind if kind not in ("date", "boolean") else "string")
        )

    keys = spark.range(0, 9000, 3).select(typed("id").alias("k")).unionByName(spark.range(1).select(F.lit(None).cast(kind).alias("k")))
    rows = spark.range(9000).select(typed("id").alias("k"), "id")
    kept = bloom.prefilter(rows, keys, "k", 1 << 20)
    assert kept is not rows
    wanted = rows.join(keys, "k", "left_semi")
    assert kept.join(keys, "k", "left_semi").count() == wanted.count()
    assert kept.count() <= wanted.count() + 600


def test_prefilter_drops_most_others_within_its_limit(spark):
    keys = spark.range(200_000).select((F.col("id") * 7).alias("k"))
    rows = spark.range(400_000).select((F.col("id") * 7 + F.when(F.col("id") % 100 == 0, 0).otherwise(3)).alias("k"))
    partners = rows.join(keys, "k", "left_semi").count()
    assert partners == 2000
    # Ten bits a key; then four, all that the limit leaves.
    assert bloom.prefilter(rows, keys, "k", 1 << 20).count() - partners < 0.04 * 398_000
    assert bloom.blocks_for(200_000, 26 * bloom.BLOCK_BYTES) == 26
    assert bloom.prefilter(rows, keys, "k", 26 * bloom.BLOCK_BYTES).count() - partners < 0.3 * 398_000
    # Below that there is none, nor where equal keys may hash apart.
    assert bloom.prefilter(rows, keys, "k", 20 * bloom.BLOCK_BYTES) is rows
    assert bloom.prefilter(rows, keys.select(F.col("k").cast("int")), "k", 1 << 20) is rows
    assert bloom.prefilter(rows.select(F.col("k").cast("double")), keys.select(F.col("k").cast("double")), "k", 1 << 20).count() == 400_000
    assert bloom.prefilter(rows, keys.limit(0), "k", 1 << 20).count() == 0


def test_filter_table_has_every_key(spark):
    keys = spark.range(3000).select((F.col("id") * 11).alias("k"))
    blocks = bloom.blocks_for(3000, 1 << 20)
    words = {r[bloom.BLOCK]: r[bloom.WORDS] for r in bloom.filter_table(keys, "k", blocks).collect()}
    assert set(words) <= set(range(blocks)) and all(len(w) <= bloom.BLOCK_WORDS for w in words.values())
    placed = keys.select(bloom._word(F.col("k"), blocks).alias("w"), bloom._mask(F.col("k")).alias("m")).collect()
    assert all(words[r["w"] // 512][r["w"] % 512] & r["m"] == r["m"] for r in placed)


def test_tag_over_the_limit_filters_in_the_scan(spark, shuffled_joins, tmp_path):
    spark.range(50_000).select("id", F.concat((F.col("id") % 40_000).cast("string"), F.lit(".tif")).alias("title")).write.parquet(str(tmp_path / "media"))
    media = spark.read.parquet(str(tmp_path / "media"))
    lists = tagging.label_table(
        [(spark.range(0, 40_000, 400).select(F.concat(F.col("id").cast("string"), F.lit(".tif")).alias("title")), 0),
         (spark.range(0, 40_000, 1000).select(F.concat(F.col("id").cast("string"), F.lit(".tif")).alias("title")), 1)],
        "title",
    )
    tagged = tagging.tag(media, lists, "title", limit_bytes=0)
    plan = plan_of(tagged)
    assert plan.count("FileScan parquet") == 1
    # The tree is printed from the top: the records' exchange stands above the filter, and that above the scan.
    top = plan.index("SortMergeJoin")
    exchange, bloomed, scan = (plan.index(x, top) for x in ("Exchange hashpartitioning(title", "BroadcastHashJoin", "FileScan parquet"))
    assert top < exchange < bloomed < scan
    assert rows_of(tagged) == rows_of(tagging.tag(media, lists, "title"))
    plain = tagging.tag(media, lists, "title", limit_bytes=0, filter_bytes=0)
    assert "BroadcastHashJoin" not in plan_of(plain) and rows_of(plain) == rows_of(tagged)
    shuffled = Observation()
    bloom.prefilter(media, lists.select("title"), "title", 1 << 20).observe(shuffled, F.count(F.lit(1)).alias("n")).repartition(
        "title"
    ).write.format("noop").mode("overwrite").save()
    assert 125 <= shuffled.get["n"] < 3000


def test_left_joins_are_not_filtered(spark, shuffled_joins):
    left, right = spark.range(100).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    joined = joins.lookup_join(left, right, "k", "left", limit_bytes=0, filter_bytes=1 << 20)
    assert joined.count() == 100 and "BroadcastHashJoin" not in plan_of(joined)


# --- label numbers


def test_label_numbers_are_those_of_spark_ml(spark):
    rows = spark.createDataFrame([(c,) for c in "bbaacccddddé日日日"], "c string")
    for order in labels.ORDERS:
        model = features.string_indexer("c", "wanted", order).fit(rows)
        found = labels.label_index(rows, "c", order).apply(model.transform(rows), "c", "found")
        assert found.filter("found <> wanted").count() == 0 and found.count() == rows.count()
    with pytest.raises(ValueError, match="order"):
        labels.label_index(rows, "c", "random")


def test_many_labels_come_in_order_over_many_partitions(spark, uncoalesced):
    rows = spark.range(30_000).select(F.concat(F.lit("k"), (F.col("id") % 20_000).cast("string")).alias("c"))
    index = labels.label_index(rows, "c")
    table = {r["label"]: r["number"] for r in index.table.collect()}
    wanted = sorted(table, key=lambda label: (-(2 if int(label[1:]) < 10_000 else 1), label))
    assert [table[label] for label in wanted] == list(range(20_000))
    assert index.table.select(F.spark_partition_id()).distinct().count() > 1


def test_rules_for_unseen_labels(spark, tmp_path):
    known = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    rows = spark.createDataFrame([(1, "a"), (2, "z"), (3, None), (4, "b")], "id int, c string")
    labels.label_index(known, "c").write(str(tmp_path / "index"))
    index = labels.LabelIndex.read(spark, str(tmp_path / "index"))
    assert rows_of(index.apply(rows, "c", "n", "skip")) == [(1, "a", 1.0), (4, "b", 0.0)]
    assert rows_of(index.apply(rows, "c", "n", "keep")) == [(1, "a", 1.0), (2, "z", 2.0), (3, None, 2.0), (4, "b", 0.0)]
    assert rows_of(index.apply(rows, "c", "n", "null", limit_bytes=0)) == [(1, "a", 1.0), (2, "z", None), (3, None, None), (4, "b", 0.0)]
    with pytest.raises(Exception, match="label without a number: (z|NULL)"):
        index.apply(rows, "c", "n").collect()
    assert rows_of(index.apply(rows.filter("c <> 'z'"), "c", "n")) == [(1, "a", 1.0), (4, "b", 0.0)]
    named = index.labels_of(index.apply(rows, "c", "n", "keep"), "n", "name").select("id", "name")
    assert rows_of(named) == [(1, "a"), (2, None), (3, None), (4, "b")]
    for wrong in ({"unseen": "other"}, {"output_col": "c"}):
        with pytest.raises(ValueError):
            index.apply(rows, "c", **{"output_col": "n", **wrong})
    empty = labels.label_index(known.limit(0), "c")
    assert empty.table.count() == 0 and rows_of(empty.apply(rows, "c", "n", "keep"))[0] == (1, "a", 0.0)


# --- bucketed tables


@pytest.fixture
def bucketed(spark, tmp_path):
    names = []

    def write(df, key, buckets=4, **options):
        names.append(f"t_{uuid.uuid4().hex}")
        tables.write_bucketed(df, names[-1], [key], buckets, path=str(tmp_path / names[-1]), **options)
        return spark.table(names[-1])

    yield write
    for name in names:
        spark.sql(f"drop table if exists {name}")


def test_bucketed_tables_join_without_an_exchange(spark, shuffled_joins, bucketed):
    records = bucketed(spark.range(5000).select((F.col("id") % 900).alias("k"), "id"), "k")
    lists = bucketed(spark.range(0, 900, 7).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("contaminated")), "k")
    tagged = tagging.tag(records, lists, "k", limit_bytes=0, filter_bytes=0)
    assert "Exchange" not in plan_of(tagged) and "SortMergeJoin" in plan_of(tagged)
    assert tagged.count() == sum(1 for i in range(5000) if i % 900 % 7 == 0)
    attached = payload.attach_payload(records, lists, "k", limit_bytes=0)
    assert "Exchange" not in plan_of(attached) and attached.count() == 5000
    sums = records.groupBy("k").count()
    assert "Exchange" not in plan_of(sums) and sums.count() == 900


def test_bucketed_files_are_found_again(spark, shuffled_joins, bucketed, tmp_path):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    table = bucketed(df, "k", spread=3)
    location = table.inputFiles()[0].rsplit("/", 1)[0]
    name = f"again_{uuid.uuid4().hex}"
    again = tables.register_bucketed(spark, name, location, df.schema, ["k"], 4)
    assert rows_of(again) == rows_of(df)
    joined = again.join(table.select("k").distinct(), "k")
    assert "Exchange" not in plan_of(joined) and joined.count() == 2000
    spark.sql(f"drop table {name}")
    with pytest.raises(Exception, match="exists|already"):
        tables.write_bucketed(df, again_name := f"u_{uuid.uuid4().hex}", ["k"], 2, path=str(tmp_path / "u"))
        tables.write_bucketed(df, again_name, ["k"], 2, path=str(tmp_path / "u"))


# --- merged statistics


def test_merged_parts_are_the_statistics_of_all(spark):
    x = np.random.default_rng(2).normal(1e6, 1e-2, (101, 11))
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, x array<double>")
    parts = [features.partial_stats(rows.filter(F.col("id") % 7 == i), "x", chunk) for i, chunk in enumerate([1, 2, 3, 4, 5, 11, 64])]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    found = features.merged_stats(merged).orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(11)) and {r["n"] for r in found} == {101}
    assert np.allclose([r["mean"] for r in found], x.mean(axis=0), rtol=1e-13)
    assert np.allclose([r["sd"] for r in found], x.std(axis=0, ddof=1), rtol=1e-6)
    assert [r["low"] for r in found] == x.min(axis=0).tolist() and [r["high"] for r in found] == x.max(axis=0).tolist()
    one = features.merged_stats(features.partial_stats(rows.filter("id = 0"), "x")).first()
    assert one["sd"] == 0.0 and one["n"] == 1
    assert features.merged_stats(features.partial_stats(rows.limit(0), "x")).count() == 0

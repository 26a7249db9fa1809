from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediaflow.operators import joins, tagging
from mediaflow.schemas import MEDIA, TITLE_FIELD, SchemaError, require_schema
from tests.conftest import plan_of, rows_of


@pytest.fixture
def media(spark):
    titles = ["a.tif", "a.tif", "b.tif", None, "01840293", "c.tif"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")


@pytest.fixture
def labels(spark):
    clean = spark.createDataFrame([("a.tif",), ("a.tif",), ("b.tif",), (None,)], "title string")
    bad = spark.createDataFrame([("b.tif",), ("01840293",), ("A.TIF",)], "title string")
    return tagging.label_table([(clean, 0), (bad, 1)], "title")


EXPECTED = [
    (0, "a.tif", 0), (1, "a.tif", 0), (2, "b.tif", 0), (2, "b.tif", 1), (4, "01840293", 1)
]


def test_tag_keeps_both_labels_and_never_multiplies(media, labels):
    assert rows_of(tagging.tag(media, labels, "title")) == EXPECTED


def test_repeated_label_rows_change_nothing(media, labels):
    assert rows_of(tagging.tag(media, labels.union(labels), "title")) == EXPECTED


def test_tag_conflict_settings(media, labels):
    dropped = tagging.tag(media, labels, "title", on_conflict="drop")
    assert rows_of(dropped) == [row for row in EXPECTED if row[1] != "b.tif"]
    with pytest.raises(tagging.LabelConflict):
        tagging.tag(media, labels, "title", on_conflict="error")
    with pytest.raises(ValueError):
        tagging.tag(media, labels, "title", on_conflict="other")
    assert rows_of(tagging.label_conflicts(labels, "title")) == [("b.tif",)]


def test_tag_equals_two_filters_and_a_union(media, labels):
    clean = labels.filter("contaminated = 0").select("title")
    bad = labels.filter("contaminated = 1").select("title")
    union = tagging.with_label(tagging.filter_by_list(media, bad, "title"), 1).unionByName(
        tagging.with_label(tagging.filter_by_list(media, clean, "title"), 0)
    )
    columns = ["id", "title", "contaminated"]
    assert rows_of(union.select(*columns)) == rows_of(
        tagging.tag(media, labels, "title").select(*columns)
    )


def test_literal_list_filter_goes_to_the_scan(spark, media, tmp_path):
    media.write.parquet(str(tmp_path / "media"))
    titles = [f"{i}.tif" for i in range(1000)] + ["b.tif"]
    kept = tagging.filter_in_list(spark.read.parquet(str(tmp_path / "media")), "title", titles)
    assert "PushedFilters: [In(title" in plan_of(kept)
    assert rows_of(kept) == [(2, "b.tif")]


def test_tag_scans_the_records_once_and_broadcasts_small_labels(spark, media, labels, tmp_path):
    media.write.parquet(str(tmp_path / "media"))
    tagged = tagging.tag(spark.read.parquet(str(tmp_path / "media")), labels, "title")
    plan = plan_of(tagged)
    assert plan.count("FileScan parquet") == 1
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and joins.SALT not in plan


def test_counts_per_label(media, labels):
    counts = tagging.tag_counts(tagging.tag(media, labels, "title"), "title")
    assert rows_of(counts) == [(0, 3, 2), (1, 2, 2)]


def test_nested_title_prunes_the_scan(spark, tmp_path):
    path = str(tmp_path / "nested")
    spark.sql(
        f"select 'u' as accessuri, named_struct('{TITLE_FIELD}', 't', 'other', 'o') as data"
    ).write.parquet(path)
    titles = spark.read.parquet(path).select("accessuri", f"data.{TITLE_FIELD}")
    assert titles.columns == ["accessuri", TITLE_FIELD]
    assert "other" not in plan_of(titles)


def test_schema_check(spark):
    good = spark.createDataFrame([("u", ("t",))], MEDIA)
    assert require_schema(good, MEDIA) is good
    with pytest.raises(SchemaError):
        require_schema(good.withColumn("accessuri", F.lit(1)), MEDIA)
    with pytest.raises(SchemaError):
        require_schema(good.drop("data"), MEDIA)


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_over_the_limit_spreads_a_hot_key(spark, no_automatic_broadcast, uncoalesced, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"),
        (F.col("id") % 2).cast("int").alias("copy"),
    ).unionByName(spark.createDataFrame([(None, 1)], "k int, copy int"))
    right = spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v"))
    joined = joins.lookup_join(left, right, "k", how, limit_bytes=0)
    assert rows_of(joined) == rows_of(left.join(right, "k", how))
    assert [tuple(row) for row in joins.hot_keys(left, "k", 4)] == [(7, 3)]
    spread = joined.withColumn("at", F.spark_partition_id()).filter("k = 7")
    assert spread.select("at").distinct().count() > 1


def test_join_over_the_limit_without_hot_keys_is_plain(spark, no_automatic_broadcast):
    left = spark.range(5000).withColumnRenamed("id", "k")
    right = spark.range(100).withColumnRenamed("id", "k")
    joined = joins.lookup_join(left, right, "k", "inner", limit_bytes=0)
    assert joins.SALT not in plan_of(joined)
    assert joined.count() == 100


def test_broadcast_needs_a_measured_size(spark):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("text"))
    assert joins.fits_broadcast(rows, 20_000)
    assert not joins.fits_broadcast(rows, 9_000)
    given = spark.createDataFrame([("x" * 1000,)] * 10, "text string")
    assert joins.fits_broadcast(given, 20_000)
    assert not joins.fits_broadcast(given, 9_000)
    assert not joins.fits_broadcast(given, 9 * joins.ROW_OVERHEAD_BYTES)

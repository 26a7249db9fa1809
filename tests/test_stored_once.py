"""Stored payloads are decoded once, whatever the join reads, and many small files share a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaflow.operators.images import bmp_bytes
from mediaflow.sources import media
from mediaflow.storage import scratch_path
from tests.conftest import plan_of


def pictures(spark, n: int):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("id") + i) % 256).cast("int"))
    return spark.range(n).select("id", bmp_bytes(pixels, 2, 2).alias("content"))


def test_the_join_reads_a_table_and_decodes_nothing_again(spark):
    decoded = media.decode_stored(pictures(spark, 50), "content")
    assert "image" not in plan_of(decoded).replace("imgnpa", "").lower()
    assert {r["id"]: r["imgnpa"] for r in decoded.collect()} == {
        i: [float((i + k) % 256) for k in range(12)] for i in range(50)
    }


def test_tasks_do_not_grow_with_the_number_of_files(spark):
    root = scratch_path(spark, "many")
    files = pictures(spark, 80).select(F.concat(F.lit("a/"), F.col("id"), F.lit(".bmp")).alias("name"), "content")
    assert media.write_files(files, root, "name", "content").count() == 80
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = media.read_decoded_images(spark, root)
        parts = found.select(F.spark_partition_id().alias("part"), "imgnpa").filter("imgnpa is not null").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) == 80
    assert len({r["part"] for r in parts}) <= media.TASKS_PER_CORE * spark.sparkContext.defaultParallelism

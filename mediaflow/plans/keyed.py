"""Queries by key: Bloom-filtered tagging, label numbers as tables, bucketed tables, merged statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.operators import features, labels, payload, tagging
from mediaflow.plans.arrays import STATS_SQL
from mediaflow.plans.records import TAGGED_SQL, label_lists
from mediaflow.plans.registry import query, table
from mediaflow.sources import tables
from mediaflow.storage import scratch_path

BUCKETS = 16


@query(
    "tag_prefiltered",
    f"""select t.doc_id, d.source, t.contaminated
    from ({TAGGED_SQL}) t join documents d on d.doc_id = t.doc_id""",
)
def tag_prefiltered(spark: SparkSession, folder: str) -> DataFrame:
    """The tag job with labels that are not broadcast: records are filtered in their scan, then shuffled."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return tagging.tag(documents, label_lists(spark, folder), "doc_id", limit_bytes=0)


@query(
    "semi_join_prefiltered",
    """select l_orderkey, l_linenumber, l_partkey from lineitem
    where l_partkey in (select p_partkey from part where p_size = 7)""",
)
def semi_join_prefiltered(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, folder, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return tagging.filter_by_list(lines, parts, "l_partkey", limit_bytes=0).select(*lines.columns)


@query(
    "label_index",
    """select o.o_orderkey, o.o_orderpriority, i.number from orders o join (
    select o_orderpriority, (row_number() over (order by count(*) desc, o_orderpriority) - 1)::double
    as number from orders group by o_orderpriority) i using (o_orderpriority)""",
)
def label_index(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return labels.label_index(orders, "o_orderpriority").apply(orders, "o_orderpriority", "number")


@query(
    "label_index_keys",
    """select l.l_orderkey, l.l_linenumber, i.number, l.l_orderkey::varchar as name from lineitem l join (
    select l_orderkey, (row_number() over (order by count(*) desc, l_orderkey::varchar) - 1)::double as number
    from lineitem group by l_orderkey) i using (l_orderkey)""",
)
def label_index_keys(spark: SparkSession, folder: str) -> DataFrame:
    """As many labels as there are orders, numbered and named again without passing through the driver."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    index = labels.label_index(lines, "l_orderkey")
    numbered = index.apply(lines, "l_orderkey", "number", limit_bytes=0)
    return index.labels_of(numbered, "number", "name", limit_bytes=0)


@query(
    "label_index_unseen",
    """with known as (select o_custkey, (row_number() over (order by o_custkey::varchar desc) - 1)::double as number
    from (select distinct o_custkey from orders where o_orderstatus = 'F'))
    select o_orderkey, coalesce(number, (select count(*) from known)::double) as number
    from orders left join known using (o_custkey)""",
)
def label_index_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers learned from some orders, applied to all; customers among the others only share the next number."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    index = labels.label_index(orders.filter("o_orderstatus = 'F'"), "o_custkey", "alphabetDesc")
    return index.apply(orders, "o_custkey", "number", unseen="keep").select("o_orderkey", "number")


def bucketed(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """The rows as a bucketed table in the shared folder."""
    name = f"bucketed_{uuid.uuid4().hex}"
    tables.write_bucketed(df, name, [key], BUCKETS, path=scratch_path(spark, "bucketed"))
    return spark.table(name)


@query(
    "bucketed_tag",
    f"""select t.doc_id, d.source, t.contaminated
    from ({TAGGED_SQL}) t join documents d on d.doc_id = t.doc_id""",
)
def bucketed_tag(spark: SparkSession, folder: str) -> DataFrame:
    documents = bucketed(spark, table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    lists = bucketed(spark, label_lists(spark, folder), "doc_id")
    return tagging.tag(documents, lists, "doc_id", limit_bytes=0, filter_bytes=0)


@query(
    "bucketed_attach",
    """select o_orderkey, o_orderpriority, n_lines, quantity from orders left join (
    select l_orderkey, count(*) as n_lines, sum(l_quantity) as quantity from lineitem group by l_orderkey)
    on l_orderkey = o_orderkey""",
)
def bucketed_attach(spark: SparkSession, folder: str) -> DataFrame:
    """Two large tables in equal buckets: grouped by key and attached with no exchange after the write."""
    orders = bucketed(spark, table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    sums = bucketed(spark, lines, "o_orderkey").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity")
    )
    return payload.attach_payload(orders, sums, "o_orderkey", check_unique=False, limit_bytes=0)


@query(
    "merged_stats",
    f"""select pos, n, round(mean, 9) as mean, round(sd, 9) as sd, low, high from ({STATS_SQL})""",
)
def merged_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of two halves, stored one after the other in pieces of different lengths, then merged."""
    path = scratch_path(spark, "stats")
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    for half, chunk in ((0, 24), (1, 4096)):
        part = features.partial_stats(rows.filter(F.col("vec_id") % 2 == half), "embedding", chunk)
        part.write.mode("append").parquet(path)
    stats = features.merged_stats(spark.read.parquet(path))
    return stats.withColumn("mean", F.round("mean", 9)).withColumn("sd", F.round("sd", 9))

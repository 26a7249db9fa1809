"""Queries over sinks and checked loads: partition overwrite, replaced tables, counts on the way, bad lines kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.operators import tagging
from mediaflow.plans.records import TAGGED_SQL, label_lists
from mediaflow.plans.registry import query, table
from mediaflow.sources import tables
from mediaflow.storage import scratch_path


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return tagging.tag(documents, label_lists(spark, folder), "doc_id")


@query(
    "sink_partition_overwrite",
    f"select doc_id, contaminated from ({TAGGED_SQL}) where contaminated = 0 or doc_id % 2 = 0",
)
def sink_partition_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one label written anew, in fewer rows; those of the other label stay."""
    path = scratch_path(spark, "by-label")
    tagged = _tagged(spark, folder)
    tables.write_table(tagged, path, partition_by=["contaminated"])
    fewer = tagged.filter("contaminated = 1 and doc_id % 2 = 0")
    tables.replace_partitions(fewer, path, ["contaminated"])
    return tables.read_table(spark, path).select("doc_id", "contaminated")


@query("sink_replace", "select doc_id, n_chars * 2 as n_chars from documents where n_chars > 1000")
def sink_replace(spark: SparkSession, folder: str) -> DataFrame:
    """A table replaced by rows computed from itself."""
    path = scratch_path(spark, "replaced")
    tables.write_table(table(spark, folder, "documents").select("doc_id", "n_chars"), path)
    stored = tables.read_table(spark, path)
    large = stored.filter("n_chars > 1000").select("doc_id", (F.col("n_chars") * 2).alias("n_chars"))
    tables.write_table(large, path, overwrite=True)
    return tables.read_table(spark, path)


@query(
    "sink_counted",
    f"""with t as (select t.contaminated, case when d.doc_id % 5 = 0 then null else d.source end as source
    from ({TAGGED_SQL}) t join documents d on d.doc_id = t.doc_id)
    select contaminated, count(source) as n_rows, (select count(*) from t) as rows_in,
    (select count(*) - count(source) from t) as dropped from t group by contaminated""",
)
def sink_counted(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per label, rows seen and rows dropped for a NULL, all counted by the job that writes."""
    gaps = _tagged(spark, folder).withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    labels = [tagging.CLEAN, tagging.CONTAMINATED]
    counts = tables.write_counted(gaps, scratch_path(spark, "counted"), "contaminated", labels, ["source"])
    rows = [(label, counts["per_label"][label], counts["rows_in"], counts["dropped"]) for label in labels]
    return spark.createDataFrame(rows, "contaminated int, n_rows bigint, rows_in bigint, dropped bigint")


# Lines of five fields: good ones, some with a word for a number, some too long, some headers.
LINE_SQL = """select case when o_orderkey % 13 = 0 then 'id' else o_orderkey::varchar end as id,
case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 17 = 0 then '' else o_custkey::varchar end as f0,
o_orderkey::varchar as f1, o_orderpriority as category,
case when o_orderkey % 11 = 0 then ',more' else '' end as rest from orders"""

CHECKED_SQL = f"""with lines as ({LINE_SQL}),
told as (select *, case when rest <> '' then 'width' when try_cast(f0 as float) is null then 'number' end as problem,
id || ',' || f0 || ',' || f1 || ',' || category || rest as line from lines where id <> 'id')
select case when problem is null then id end as id, case when problem is null then try_cast(f0 as float)::double end as f0,
case when problem is null then f1::float::double end as f1, case when problem is null then category end as category,
problem, case when problem is not null then line end as bad_line from told"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    first = F.when(key % 13 == 0, "id").otherwise(key.cast("string"))
    number = F.when(key % 7 == 0, "n/a").when(key % 17 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    rest = F.when(key % 11 == 0, ",more").otherwise("")
    line = F.concat(F.concat_ws(",", first, number, key.cast("string"), F.col("o_orderpriority")), rest)
    return table(spark, folder, "orders").select(line.alias("value"))


@query("csv_bad_lines", CHECKED_SQL)
def csv_bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All lines from one scan, the bad ones with their text and what is wrong with them."""
    checked = tables.checked_lines(_lines(spark, folder), 2)
    values = [F.col("features")[i].cast("double").alias(f"f{i}") for i in range(2)]
    return checked.select("id", *values, "category", "problem", "bad_line")


@query(
    "csv_good_and_bad",
    f"""select coalesce(problem, 'none') as problem, count(*) as n_lines, count(category) as n_good,
    sum(f0 + f1) as total, sum(length(bad_line))::bigint as bad_chars from ({CHECKED_SQL}) group by problem""",
)
def csv_good_and_bad(spark: SparkSession, folder: str) -> DataFrame:
    """A quoted load written once, its good and bad lines read back apart."""
    path = scratch_path(spark, "checked")
    tables.write_checked(tables.checked_lines(_lines(spark, folder), 2, quoted=True), path)
    good = tables.read_checked(spark, path).select(
        F.lit("none").alias("problem"),
        "category",
        F.aggregate("features", F.lit(0.0), lambda total, x: total + x.cast("double")).alias("value"),
        F.lit(None).cast("string").alias("bad_line"),
    )
    bad = tables.read_checked(spark, path, bad=True).select(
        "problem", F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("value"), "bad_line"
    )
    return good.unionByName(bad).groupBy("problem").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count("category").alias("n_good"),
        F.sum("value").alias("total"),
        F.sum(F.length("bad_line")).cast("bigint").alias("bad_chars"),
    )

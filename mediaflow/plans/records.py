"""Queries over records: tagging, filters, joins, splits, order, sources, sinks and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.functions.hashing import seeded_uniform
from mediaflow.operators import evaluate, features, payload, sampling, tagging
from mediaflow.operators.joins import lookup_join
from mediaflow.plans.registry import query, table
from mediaflow.schemas import TITLE_FIELD
from mediaflow.sources import tables
from mediaflow.storage import scratch_path

# Titles looked for by the literal-list filter.
TITLES = ["red plate", "small widget", "hot ring", "large rod", "no such title"]

SPLIT_SEED = 314
HOLDOUT_SEED = 2718


def _listed(spark: SparkSession, folder: str, flag: str) -> DataFrame:
    return table(spark, folder, "labels").filter(F.col(flag) == 1).select("doc_id")


def label_lists(spark: SparkSession, folder: str) -> DataFrame:
    lists = [
        (_listed(spark, folder, "quality"), tagging.CLEAN),
        (_listed(spark, folder, "toxic"), tagging.CONTAMINATED),
    ]
    return tagging.label_table(lists, "doc_id")


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their grades; NULL where a document was not graded."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return payload.attach_payload(documents, table(spark, folder, "labels"), "doc_id")


TAGGED_SQL = """
select d.doc_id, 0::int as contaminated from documents d
where d.doc_id in (select doc_id from labels where quality = 1)
union all
select d.doc_id, 1::int as contaminated from documents d
where d.doc_id in (select doc_id from labels where toxic = 1)
"""


@query(
    "tag_counts",
    f"""select contaminated, count(*) as n_rows, count(distinct doc_id) as n_keys
    from ({TAGGED_SQL}) group by contaminated""",
)
def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    tagged = tagging.tag(documents, label_lists(spark, folder), "doc_id")
    return tagging.tag_counts(tagged, "doc_id")


@query(
    "tag_records",
    f"""select t.doc_id, d.source, t.contaminated
    from ({TAGGED_SQL}) t join documents d on d.doc_id = t.doc_id""",
)
def tag_records(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return tagging.tag(documents, label_lists(spark, folder), "doc_id")


@query(
    "tag_without_conflicts",
    f"""select doc_id, min(contaminated)::int as contaminated from ({TAGGED_SQL})
    group by doc_id having count(distinct contaminated) = 1""",
)
def tag_without_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    return tagging.tag(documents, label_lists(spark, folder), "doc_id", on_conflict="drop")


@query(
    "tag_semi_join",
    """select doc_id, n_chars from documents
    where doc_id in (select doc_id from labels where toxic = 1)""",
)
def tag_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    return tagging.filter_by_list(documents, _listed(spark, folder, "toxic"), "doc_id")


@query(
    "tag_constant",
    """select doc_id, 1::int as contaminated from documents
    where doc_id in (select doc_id from labels where toxic = 1)""",
)
def tag_constant(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    kept = tagging.filter_by_list(documents, _listed(spark, folder, "toxic"), "doc_id")
    return tagging.with_label(kept, tagging.CONTAMINATED)


@query("tag_union", TAGGED_SQL)
def tag_union(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    clean = tagging.filter_by_list(documents, _listed(spark, folder, "quality"), "doc_id")
    bad = tagging.filter_by_list(documents, _listed(spark, folder, "toxic"), "doc_id")
    return tagging.with_label(bad, tagging.CONTAMINATED).unionByName(
        tagging.with_label(clean, tagging.CLEAN)
    )


@query(
    "label_conflicts",
    """select doc_id from labels where quality = 1
    intersect select doc_id from labels where toxic = 1""",
)
def label_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.label_conflicts(label_lists(spark, folder), "doc_id")


@query(
    "attach_payload",
    """select l.doc_id, length(p.html)::int as n_chars, md5(p.html) as digest,
    p.page_id is not null as found from labels l left join pages p on p.page_id = l.doc_id""",
)
def attach_payload(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "labels").select("doc_id")
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return payload.attach_payload(refs, pages, "doc_id").select(
        "doc_id",
        F.length("html").alias("n_chars"),
        F.md5("html").alias("digest"),
        F.col("html").isNotNull().alias("found"),
    )


@query("project", "select doc_id, source, lang from documents")
def project(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang")


@query("project_nested", f'select doc_id, source as "{TITLE_FIELD}" from documents')
def project_nested(spark: SparkSession, folder: str) -> DataFrame:
    fields = F.struct(F.col("source").alias(TITLE_FIELD), F.col("lang").alias("dcterms:language"))
    media = table(spark, folder, "documents").select("doc_id", fields.alias("data"))
    return media.select("doc_id", f"data.{TITLE_FIELD}")


@query(
    "filter_in_list",
    "select p_partkey, p_name from part where p_name in ("
    + ", ".join(f"'{title}'" for title in TITLES)
    + ")",
)
def filter_in_list(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return tagging.filter_in_list(parts, "p_name", TITLES)


@query("filter_not_null", "select doc_id, quality from labels")
def filter_not_null(spark: SparkSession, folder: str) -> DataFrame:
    graded = _graded(spark, folder)
    return graded.filter(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(
    "drop_any_null",
    """select d.doc_id, d.source, l.quality, l.toxic
    from documents d join labels l on l.doc_id = d.doc_id
    where d.source is not null and l.quality is not null and l.toxic is not null""",
)
def drop_any_null(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder).dropna(how="any")


@query(
    "hash_split",
    """select doc_id, case when ('0x' || substr(md5(doc_id::varchar || ':314'), 1, 8))::bigint
    / 4294967296.0::double < 0.8::double then 'train' else 'test' end as split from documents""",
)
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    return sampling.with_split(documents, "doc_id", {"train": 80, "test": 20}, SPLIT_SEED)


@query(
    "holdout_split",
    """select doc_id, case when ('0x' || substr(md5(doc_id::varchar || ':2718'), 1, 8))::bigint
    / 4294967296.0::double < 0.85::double then 'fit' else 'validation' end as part
    from documents where ('0x' || substr(md5(doc_id::varchar || ':314'), 1, 8))::bigint
    / 4294967296.0::double < 0.8::double""",
)
def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    train, _ = sampling.hash_split(documents, "doc_id", [80, 20], SPLIT_SEED)
    return sampling.with_split(train, "doc_id", {"fit": 85, "validation": 15}, HOLDOUT_SEED, "part")


@query(
    "three_way_split",
    """select o_orderkey, case when u < 0.7::double then 'train' when u < 0.9::double
    then 'validation' else 'test' end as split from (select o_orderkey,
    ('0x' || substr(md5(o_orderkey::varchar || ':314'), 1, 8))::bigint / 4294967296.0::double as u
    from orders)""",
)
def three_way_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    weights = {"train": 70, "validation": 20, "test": 10}
    return sampling.with_split(orders, "o_orderkey", weights, SPLIT_SEED)


@query(
    "random_split",
    """select count(*) as n_rows, sum(o_orderkey)::bigint as key_sum, true as share_is_near
    from orders""",
)
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    train, test = sampling.random_split(orders, [0.8, 0.2], SPLIT_SEED)
    parts = train.withColumn("is_train", F.lit(1.0)).unionByName(
        test.withColumn("is_train", F.lit(0.0))
    )
    return parts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("o_orderkey").alias("key_sum"),
        F.avg("is_train").between(0.74, 0.86).alias("share_is_near"),
    )


@query(
    "shuffle_rows",
    "select o_orderkey, o_orderpriority, md5(o_orderkey::varchar || ':7') as order_key from orders",
)
def shuffle_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.shuffle_rows(orders, "o_orderkey", 7)


@query("random_order", "select o_orderkey, o_orderstatus from orders")
def random_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.random_order(orders, 7)


@query(
    "limit_then_filter",
    """select doc_id, grade from (select doc_id, nullif(quality, 0) as grade from labels
    order by doc_id limit 100) where grade is not null""",
)
def limit_then_filter(spark: SparkSession, folder: str) -> DataFrame:
    grade = F.nullif(F.col("quality"), F.lit(0)).alias("grade")
    graded = table(spark, folder, "labels").select("doc_id", grade)
    return sampling.limit_then_filter(graded, 100, F.col("grade").isNotNull(), "doc_id")


@query(
    "filter_then_limit",
    """select doc_id, nullif(quality, 0) as grade from labels where nullif(quality, 0) is not null
    order by doc_id limit 100""",
)
def filter_then_limit(spark: SparkSession, folder: str) -> DataFrame:
    grade = F.nullif(F.col("quality"), F.lit(0)).alias("grade")
    graded = table(spark, folder, "labels").select("doc_id", grade)
    return sampling.filter_then_limit(graded, 100, F.col("grade").isNotNull(), "doc_id")


@query(
    "head_n",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem
    order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 10""",
)
def head_n(spark: SparkSession, folder: str) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return sampling.head_rows(table(spark, folder, "lineitem").select(*names), 10, *names)


@query("row_count", "select count(*) as n_rows from lineitem")
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))


@query("count_if", "select count(*) as n_passed from lineitem where l_discount > 0.05")
def count_if(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.count_if(table(spark, folder, "lineitem"), F.col("l_discount") > 0.05)


@query(
    "pi_estimate",
    """select count(*) as n_points, count(*) filter (x * x + y * y < 1) as n_inside,
    4.0::double * count(*) filter (x * x + y * y < 1) / count(*) as pi
    from (select ('0x' || substr(md5(k || ':11'), 1, 8))::bigint / 4294967296.0::double as x,
    ('0x' || substr(md5(k || ':11'), 9, 8))::bigint / 4294967296.0::double as y
    from (select l_orderkey::varchar || '-' || l_linenumber::varchar || '-' || l_partkey::varchar
    as k from lineitem))""",
)
def pi_estimate(spark: SparkSession, folder: str) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "l_partkey"]
    keys = table(spark, folder, "lineitem").select(F.concat_ws("-", *names).alias("k"))
    x, y = seeded_uniform(F.col("k"), 11), seeded_uniform(F.col("k"), 11, word=1)
    points = keys.select(x.alias("x"), y.alias("y"))
    return evaluate.unit_circle_estimate(points, F.col("x"), F.col("y"))


@query(
    "random_points",
    "select count(*) as n_points, true as is_near from lineitem",
)
def random_points(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "lineitem").select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    estimate = evaluate.unit_circle_estimate(points, F.col("x"), F.col("y"))
    return estimate.select("n_points", F.col("pi").between(3.0, 3.3).alias("is_near"))


@query("n_classes", "select count(distinct o_orderpriority) as n_classes from orders")
def n_classes(spark: SparkSession, folder: str) -> DataFrame:
    return features.class_count(table(spark, folder, "orders"), "o_orderpriority")


@query("distinct_labels", "select distinct o_orderpriority as category from orders")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(F.col("o_orderpriority").alias("category")).distinct()


@query(
    "label_freq",
    "select o_orderpriority, count(*) as n from orders group by o_orderpriority",
)
def label_freq(spark: SparkSession, folder: str) -> DataFrame:
    return features.label_frequency(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "describe_lengths",
    """select count(length(text)) as n, round(avg(length(text)), 6) as mean,
    round(stddev_samp(length(text)), 6) as sd, min(length(text))::int as low,
    max(length(text))::int as high from documents""",
)
def describe_lengths(spark: SparkSession, folder: str) -> DataFrame:
    stats = features.describe_lengths(table(spark, folder, "documents"), F.length("text"))
    return stats.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(
    "string_index",
    """select o.o_orderkey, o.o_orderpriority, i.index_category from orders o join (
    select o_orderpriority, (row_number() over (order by count(*) desc, o_orderpriority) - 1)::double
    as index_category from orders group by o_orderpriority) i using (o_orderpriority)""",
)
def string_index(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return features.string_index(orders, "o_orderpriority", "index_category")[0]


@query(
    "media_url",
    "select doc_id, 'https://media.example.org/get?ref=' || source as url from documents",
)
def media_url(spark: SparkSession, folder: str) -> DataFrame:
    url = payload.media_url("https://media.example.org/get?ref=", "source")
    return table(spark, folder, "documents").select("doc_id", url.alias("url"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

FEATURE_COLUMNS_SQL = ", ".join(f"{name}::float::double as f{i}" for i, name in enumerate(NUMBERS))


def _feature_columns() -> list:
    return [F.col("features")[i].cast("double").alias(f"f{i}") for i in range(len(NUMBERS))]


def _line_table(spark: SparkSession, folder: str) -> DataFrame:
    id_text = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, folder, "lineitem").select(
        id_text.alias("id"), *[F.col(name).cast("string").alias(name) for name in NUMBERS],
        "l_returnflag",
    )


@query("csv_load_train", f"select {FEATURE_COLUMNS_SQL}, l_returnflag as category from lineitem")
def csv_load_train(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "train-lines")
    lines = _line_table(spark, folder)
    lines.select(F.concat_ws(",", *lines.columns)).write.text(path)
    loaded = tables.load_lines(spark, path, train=True, shuffle_seed=SPLIT_SEED)
    return loaded.select(*_feature_columns(), "category")


@query("csv_load_test", f"select {FEATURE_COLUMNS_SQL}, 'Class_1' as category from lineitem")
def csv_load_test(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "test-lines")
    _line_table(spark, folder).drop("l_returnflag").write.csv(path, header=True)
    loaded = tables.load_csv(spark, path, len(NUMBERS), train=False, header=True)
    return loaded.select(*_feature_columns(), "category")


@query(
    "csv_header_drop",
    """select o_orderkey::varchar as id, o_orderpriority as category from orders
    where o_orderstatus <> 'P'""",
)
def csv_header_drop(spark: SparkSession, folder: str) -> DataFrame:
    first = F.when(F.col("o_orderstatus") == "P", "id").otherwise(F.col("o_orderkey").cast("string"))
    lines = table(spark, folder, "orders").select(
        F.concat_ws(",", first, "o_totalprice", "o_orderpriority").alias("value")
    )
    parts = tables.split_lines(lines)
    return parts.select(F.col("parts")[0].alias("id"), F.element_at("parts", -1).alias("category"))


@query(
    "array_slice",
    """select o_orderkey, o_orderkey::varchar as head, o_orderpriority as tail,
    o_orderstatus || '|' || o_custkey::varchar as middle,
    o_orderstatus || '|' || o_custkey::varchar || '|' || o_orderpriority as rest from orders""",
)
def array_slice(spark: SparkSession, folder: str) -> DataFrame:
    names = ["o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority"]
    orders = table(spark, folder, "orders")
    parts = orders.select("o_orderkey", F.split(F.concat_ws(",", *names), ",").alias("parts"))
    return parts.select(
        "o_orderkey",
        tables.first_part("parts").alias("head"),
        tables.last_part("parts").alias("tail"),
        F.array_join(tables.without_ends("parts"), "|").alias("middle"),
        F.array_join(tables.without_first("parts"), "|").alias("rest"),
    )


@query(
    "array_cast",
    """select o_orderkey, o_totalprice::float::double as f0, o_custkey::float::double as f1
    from orders""",
)
def array_cast(spark: SparkSession, folder: str) -> DataFrame:
    text = F.array(F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"))
    cast = table(spark, folder, "orders").select("o_orderkey", tables.to_floats(text).alias("f"))
    return cast.select(
        "o_orderkey",
        F.col("f")[0].cast("double").alias("f0"),
        F.col("f")[1].cast("double").alias("f1"),
    )


@query("sink_roundtrip", TAGGED_SQL)
def sink_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    path = scratch_path(spark, "tagged")
    tables.write_table(tagging.tag(documents, label_lists(spark, folder), "doc_id"), path)
    return tables.read_table(spark, path)


@query(
    "sink_overwrite",
    f"select contaminated, count(*) as n_rows from ({TAGGED_SQL}) group by contaminated",
)
def sink_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    path = scratch_path(spark, "overwritten")
    tables.write_table(documents, path)
    tagged = tagging.tag(documents, label_lists(spark, folder), "doc_id")
    tables.write_table(tagged, path, overwrite=True, partition_by=["contaminated"])
    back = tables.read_table(spark, path)
    return back.groupBy("contaminated").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "join_over_limit",
    """select l_orderkey, l_linenumber, l_partkey, p_name from (
    select *, case when l_partkey % 3 = 0 then 1 else l_partkey end as k from lineitem)
    left join part on p_partkey = k""",
)
def join_over_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup that is not broadcast, with a third of the rows on one key."""
    key = F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(F.col("l_partkey")).cast("bigint")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("k"))
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return lookup_join(lines, names, "k", "left", limit_bytes=0).drop("k")

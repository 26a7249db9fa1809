"""Queries over pictures: encoded, fetched, decoded, resized and materialised.

Picture files are made by Spark from the embeddings: 8 x 8 values 0 to 255 in three channels, as
uncompressed BMP files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.operators import fetching, images, payload
from mediaflow.plans.arrays import SIDE, exploded
from mediaflow.plans.registry import query, table
from mediaflow.sources import media
from mediaflow.storage import scratch_path

FILE_BYTES = 54 + SIDE * SIDE * 3

GREY_SQL = "greatest(0, least(255, floor({})))::int"

PICTURE_SQL = f"""select vec_id, label, flatten([[
{GREY_SQL.format('127.5::double + 127.5::double * v::double')},
{GREY_SQL.format('127.5::double - 127.5::double * v::double')},
{GREY_SQL.format('255.0::double * v::double * v::double')}] for v in embedding]) as x
from embeddings"""


def _grey(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value))).cast("int")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out to every core. A count is given, since adaptive execution joins small partitions otherwise."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def picture_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, pixels): 8 x 8 x 3 values 0 to 255 per embedding."""
    dots = F.transform(
        F.transform("embedding", lambda v: v.cast("double")),
        lambda v: F.array(_grey(127.5 + 127.5 * v), _grey(127.5 - 127.5 * v), _grey(255.0 * v * v)),
    )
    scan = spread(table(spark, folder, "embeddings"), "vec_id")
    return scan.select("vec_id", "label", F.flatten(dots).alias("pixels"))


def picture_files(spark: SparkSession, folder: str, by_class: bool) -> str:
    """Write the pictures as files, in one folder per class or all in one; gives the root."""
    root = scratch_path(spark, "pictures")
    leaf = F.concat(F.col("vec_id").cast("string"), F.lit(".bmp"))
    name = F.concat(F.lit("class-"), F.col("label").cast("string"), F.lit("/"), leaf)
    files = picture_rows(spark, folder).select(
        (name if by_class else leaf).alias("name"),
        images.bmp_bytes("pixels", SIDE, SIDE).alias("content"),
    )
    media.write_files(files, root, "name", "content").agg(F.sum("n_bytes")).first()
    return root


@query(
    "image_dir_labels",
    f"""select 'class-' || label::varchar as class,
    (dense_rank() over (order by 'class-' || label::varchar) - 1)::int as class_id,
    count(*) as n_files, (count(*) * {FILE_BYTES})::bigint as n_bytes
    from embeddings group by label""",
)
def image_dir_labels(spark: SparkSession, folder: str) -> DataFrame:
    files = media.read_image_files(spark, picture_files(spark, folder, by_class=True), "*.bmp")
    return (
        media.with_class_id(files.select("class", "length"))
        .groupBy("class", "class_id")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    )


@query(
    "image_source",
    f"""select vec_id, 'class-' || label::varchar as class, 8::int as height, 8::int as width,
    3::int as channels, unnest(range(192))::int as pos, unnest(x)::double as value
    from ({PICTURE_SQL})""",
)
def image_source(spark: SparkSession, folder: str) -> DataFrame:
    root = picture_files(spark, folder, by_class=True)
    pictures = media.read_decoded_images(spark, root)
    vec_id = F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("bigint")
    return pictures.select(
        vec_id.alias("vec_id"),
        "class",
        "height",
        "width",
        "channels",
        F.posexplode("imgnpa").alias("pos", "value"),
    ).withColumn("value", F.col("value").cast("double"))


@query(
    "fetch_payload",
    f"""select d.doc_id, case when e.vec_id is null then null else {FILE_BYTES} end::int as n_bytes,
    e.vec_id is null as failed from documents d left join embeddings e on e.vec_id = d.doc_id""",
)
def fetch_payload(spark: SparkSession, folder: str) -> DataFrame:
    return _fetched(spark, folder).select(
        "doc_id",
        F.octet_length("payload").alias("n_bytes"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    "fetch_resumed",
    f"""select d.doc_id, case when e.vec_id is null then null else {FILE_BYTES} end::int as n_bytes,
    e.vec_id is null as failed, 1 as tries from documents d left join embeddings e on e.vec_id = d.doc_id""",
)
def fetch_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched in two runs: half of the references, then all; each is asked for once."""
    fetch = payload.file_fetcher(picture_files(spark, folder, by_class=False))
    path = scratch_path(spark, "attempts")
    refs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".bmp")).alias("reference")
    )
    fetching.fetch_missing(refs.filter("doc_id % 2 = 0"), "reference", fetch, path)
    fetching.fetch_missing(refs, "reference", fetch, path, slices=2)
    tries = fetching.read_attempts(spark, path).groupBy("reference").agg(F.sum("tries").cast("int").alias("tries"))
    return fetching.with_fetched(refs, "reference", path).join(tries, "reference").select(
        "doc_id",
        F.octet_length("payload").alias("n_bytes"),
        F.col("error").isNotNull().alias("failed"),
        "tries",
    )


@query(
    "failure_counts",
    """select count(*) as n_rows, count(*) filter (e.vec_id is null) as n_failed
    from documents d left join embeddings e on e.vec_id = d.doc_id""",
)
def failure_counts(spark: SparkSession, folder: str) -> DataFrame:
    return payload.failure_counts(_fetched(spark, folder))


def _fetched(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads for every document, of which those without an embedding have no file."""
    fetch = payload.file_fetcher(picture_files(spark, folder, by_class=False))
    scan = table(spark, folder, "documents").select("doc_id")
    refs = spread(scan, "doc_id").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".bmp")).alias("reference")
    )
    return payload.fetch_payload(refs, "reference", fetch)


@query(
    "image_decode",
    f"""select vec_id, unnest(range(192))::int as pos, unnest(x)::double as value
    from ({PICTURE_SQL})""",
)
def image_decode(spark: SparkSession, folder: str) -> DataFrame:
    content = images.bmp_bytes("pixels", SIDE, SIDE).alias("content")
    files = picture_rows(spark, folder).select("vec_id", content)
    decoded = images.decode_images(files, "content")
    return exploded(decoded, F.col("imgnpa"), "vec_id").withColumn(
        "value", F.col("value").cast("double")
    )


@query(
    "image_decode_stored",
    f"""select vec_id, unnest(range(192))::int as pos, unnest(x)::double as value
    from ({PICTURE_SQL})""",
)
def image_decode_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads in a column, decoded by Spark's image source."""
    content = images.bmp_bytes("pixels", SIDE, SIDE).alias("content")
    files = picture_rows(spark, folder).select("vec_id", content)
    decoded = media.decode_stored(files, "content")
    return exploded(decoded, F.col("imgnpa"), "vec_id").withColumn(
        "value", F.col("value").cast("double")
    )


def _weights_sql(size_out: int) -> str:
    """Rows (o, i, w): fixed-point weight of input position i for output position o."""
    step = f"(8 / {size_out}::double)"
    return f"""select o, i, trunc(k / sum(k) over (partition by o) * 4194304
    + 0.5 * sign(k / sum(k) over (partition by o)))::bigint as w from (
    select o, i, case when t = 0 then 1.0::double when abs(t) < 3
    then sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) else 0.0::double end as k
    from (select o, i, (i - (o + 0.5::double) * {step} + 0.5::double) / greatest({step}, 1.0::double)
    as t from (select unnest(range({size_out})) as o), (select unnest(range(8)) as i)
    where i >= floor((o + 0.5::double) * {step} - 3 * greatest({step}, 1.0::double) + 0.5::double)
    and i < floor((o + 0.5::double) * {step} + 3 * greatest({step}, 1.0::double) + 0.5::double)))"""


def resized_sql(height: int, width: int) -> str:
    """Rows (vec_id, y, x, c, value): the pictures resized along x, rounded, then along y."""
    clip = "greatest(0, least(255, floor((sum(value * w) + 2097152) / 4194304::double)))::bigint"
    return f"""select vec_id, o as y, x, c, {clip} as value from (
    select vec_id, y, o as x, c, {clip} as value from (
    select vec_id, p // 24 as y, (p % 24) // 3 as x, p % 3 as c, value from (
    select vec_id, unnest(range(192)) as p, unnest(x)::bigint as value from ({PICTURE_SQL})))
    join ({_weights_sql(width)}) on i = x group by vec_id, y, o, c)
    join ({_weights_sql(height)}) on i = y group by vec_id, o, x, c"""


RESIZED_HEIGHT, RESIZED_WIDTH = 12, 5


@query(
    "image_resize",
    f"""select vec_id, ((y * {RESIZED_WIDTH} + x) * 3 + c)::int as pos, value::double as value
    from ({resized_sql(RESIZED_HEIGHT, RESIZED_WIDTH)})""",
)
def image_resize(spark: SparkSession, folder: str) -> DataFrame:
    rows = picture_rows(spark, folder).select("vec_id", "pixels")
    resized = images.resize_pixels(
        rows, "pixels", (SIDE, SIDE), (RESIZED_HEIGHT, RESIZED_WIDTH), output_col="imgnpa"
    )
    return exploded(resized, F.col("imgnpa"), "vec_id").withColumn(
        "value", F.col("value").cast("double")
    )


TARGET_SIDE = 32


@query(
    "image_materialise",
    f"""select d.doc_id, r.n_values, r.pixel_sum, r.pixel_check from documents d left join (
    select vec_id, count(*)::int as n_values, sum(value)::bigint as pixel_sum,
    sum(value * ((y * {TARGET_SIDE} + x) * 3 + c + 1))::bigint as pixel_check
    from ({resized_sql(TARGET_SIDE, TARGET_SIDE)}) group by vec_id) r on r.vec_id = d.doc_id""",
)
def image_materialise(spark: SparkSession, folder: str) -> DataFrame:
    fetch = payload.file_fetcher(picture_files(spark, folder, by_class=False))
    scan = table(spark, folder, "documents").select("doc_id")
    refs = spread(scan, "doc_id").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".bmp")).alias("accessuri")
    )
    rows = images.materialise_images(refs, "accessuri", fetch, TARGET_SIDE, TARGET_SIDE)
    whole = F.transform("imgnpa", lambda v, i: v.cast("bigint") * (i + 1))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "doc_id",
        F.size("imgnpa").alias("n_values"),
        F.aggregate("imgnpa", zero, lambda acc, v: acc + v.cast("bigint")).alias("pixel_sum"),
        F.aggregate(whole, zero, lambda acc, v: acc + v).alias("pixel_check"),
    )

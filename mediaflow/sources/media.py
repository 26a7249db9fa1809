"""Image files: directory trees with one folder per class, and files written one per row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.operators.features import string_indexer
from mediaflow.operators.images import flatten_rasters
from mediaflow.operators.joins import lookup_join
from mediaflow.schemas import require_columns
from mediaflow.shipping import ship_package
from mediaflow.storage import arrow_path, scratch_path


TASKS_PER_CORE = 4


def class_of_path(path: str | Column) -> Column:
    """Name of the folder a file lies in."""
    column = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(column, "/"), -2)


def read_image_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a class tree: (path, class, length, content).

    ``content`` is read from storage only where a later step selects it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select("path", class_of_path("path").alias("class"), "length", "content")


def with_class_id(
    df: DataFrame,
    class_col: str = "class",
    id_col: str = "class_id",
    like: DataFrame | None = None,
) -> DataFrame:
    """Number the classes in alphabetical order, from 0.

    For a validation tree, ``like`` is the training tree whose numbers hold; a class it lacks is an
    error.
    """
    indexer = string_indexer(class_col, "__index", "alphabetAsc")
    indexed = indexer.fit(df if like is None else like).transform(df)
    return indexed.withColumn(id_col, F.col("__index").cast("int")).drop("__index")


def read_decoded_images(
    spark: SparkSession,
    root: str,
    height: int | None = None,
    width: int | None = None,
    drop_invalid: bool = False,
) -> DataFrame:
    """Pictures below a class tree, decoded by Spark's image source and resized if a size is given.

    Gives (path, class, height, width, channels, imgnpa). A file that is no picture has a NULL
    array, or is left out with ``drop_invalid``. Spark plans a partition for few files, however small they are; a task
    takes many of these one after another, ``TASKS_PER_CORE`` for each core.
    """
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", str(drop_invalid).lower())
        .load(root)
    )
    rasters = images.select(
        F.col("image.origin").alias("path"),
        class_of_path("image.origin").alias("class"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    rasters = rasters.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return flatten_rasters(rasters, height, width)


def write_files(df: DataFrame, root: str, name_col: str, content_col: str) -> DataFrame:
    """Write one file per row below a shared folder, from the tasks; gives (name, n_bytes).

    A file goes to a name of its own first and is then moved, so a task that runs twice leaves
    whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = arrow_path(root)
        folders: set[str] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = []
            for name, content in zip(names, batch.column(1)):
                target = f"{base}/{name}"
                folder, _, leaf = target.rpartition("/")
                if folder not in folders:
                    filesystem.create_dir(folder, recursive=True)
                    folders.add(folder)
                partial = f"{folder}/.{leaf}.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(partial) as stream:
                    stream.write(content.as_py())
                filesystem.move(partial, target)
                sizes.append(len(content.as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64())], names=["name", "n_bytes"]
            )

    chosen = df.select(F.col(name_col).alias("name"), F.col(content_col).alias("content"))
    ship_package(df.sparkSession)
    return chosen.mapInArrow(run, "name string, n_bytes bigint")


def decode_stored(
    df: DataFrame,
    content_col: str,
    height: int | None = None,
    width: int | None = None,
    output_col: str = "imgnpa",
    error_col: str = "error",
    num_partitions: int | None = None,
) -> DataFrame:
    """Append the pixel array of every payload, decoded by Spark's image source: JPEG, PNG, GIF, BMP and TIFF.

    One decoder serves every row, whatever the workers have installed. The source reads files, so each distinct payload
    is written to the shared folder once, in one of 256 folders by its digest, and its pixels are joined back by that
    digest: equal payloads are stored and decoded once, and their pixels are written to a table, which the join may read
    again. It takes a small file for each; BMP and PNG alone need none, see ``operators.images.decode_images``. A payload that is no picture, or NULL, gives NULL and a reason.
    """
    require_columns(df, [content_col])
    spark = df.sparkSession
    root = scratch_path(spark, "payloads")
    digest = F.sha2(F.col(f"`{content_col}`"), 256)
    files = (
        df.filter(F.col(f"`{content_col}`").isNotNull())
        .select(F.concat(F.substring(digest, 1, 2), F.lit("/"), digest).alias("name"), F.col(f"`{content_col}`").alias("content"))
        # A digest decides the content, so the first is as good as any; copies meet before a file is written.
        .groupBy("name")
        .agg(F.first("content").alias("content"))
        .repartition(num_partitions or spark.sparkContext.defaultParallelism, "name")
    )
    # The folder must be there to be read, also where there is nothing to write.
    if write_files(files, root, "name", "content").agg(F.count(F.lit(1)).alias("n")).first()["n"]:
        decoded = read_decoded_images(spark, root, height, width).select(
            F.element_at(F.split("path", "/"), -1).alias("__digest"), F.col("imgnpa").alias(output_col)
        )
        table = scratch_path(spark, "pixels")
        decoded.write.parquet(table)
        decoded = spark.read.schema(decoded.schema).parquet(table)
    else:
        decoded = spark.createDataFrame([], f"__digest string, `{output_col}` array<float>")
    joined = lookup_join(df.withColumn("__digest", digest), decoded, "__digest", "left")
    reason = F.when(F.col(f"`{content_col}`").isNull(), "no payload").when(F.col(output_col).isNull(), "no picture that can be read")
    kept = [F.col(f"`{name}`") for name in df.columns if name not in (output_col, error_col)]
    return joined.select(*kept, F.col(output_col), reason.alias(error_col))

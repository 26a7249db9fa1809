"""The whole workload on a small made-up collection, from nested metadata to a confusion table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaflow.functions.tensors import has_shape, scale_by
from mediaflow.operators import evaluate, images, joins, payload, sampling, tagging
from mediaflow.operators.network import conv_spec
from mediaflow.operators.training import AveragedNetwork
from mediaflow.schemas import IMAGES, MEDIA, TAGGED, TITLE_FIELD, require_schema
from mediaflow.sources import tables
from mediaflow.storage import scratch_path
from tests.test_media import png

N = 80


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    """Dark and bright pictures; the bright ones are on the contaminated list, one file is missing."""
    root = tmp_path_factory.mktemp("files")
    draw = np.random.default_rng(0)
    for i in range(N):
        base = 180 if i % 2 else 20
        pixels = (base + draw.integers(0, 40, (30, 26, 3))).astype(np.uint8)
        if i:
            (root / f"{i}.png").write_bytes(png(pixels))
    rows = [(f"{i}.png", (f"title {i}",)) for i in range(N)] + [("none.png", (None,))]
    path = scratch_path(spark, "media")
    spark.createDataFrame(rows, MEDIA).write.parquet(path)
    return root, path


def label_lists(spark):
    clean = [(f"title {i}",) for i in range(0, N, 2)] * 2
    bad = [(f"title {i}",) for i in range(1, N, 2)]
    frames = [spark.createDataFrame(rows, f"`{TITLE_FIELD}` string") for rows in (clean, bad)]
    return tagging.label_table([(frames[0], 0), (frames[1], 1)], TITLE_FIELD)


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_LIMIT_BYTES])
def test_tag_by_nested_title(spark, collection, limit):
    media = tables.read_table(spark, collection[1], MEDIA).select("accessuri", f"data.{TITLE_FIELD}")
    tagged = tagging.tag(media, label_lists(spark), TITLE_FIELD, limit_bytes=limit)
    assert tagged.count() == N
    require_schema(tagged, TAGGED)


def test_from_metadata_to_confusion_table(spark, collection):
    root, path = collection
    media = tables.read_table(spark, path, MEDIA).select("accessuri", f"data.{TITLE_FIELD}")
    tagged = sampling.random_order(tagging.tag(media, label_lists(spark), TITLE_FIELD), 314)
    tagged_path = scratch_path(spark, "tagged")
    tables.write_table(tagged, tagged_path)

    refs = tables.read_table(spark, tagged_path, TAGGED).select("accessuri", "contaminated")
    pictures = images.materialise_images(
        refs, "accessuri", payload.file_fetcher(f"file://{root}"), 32, 32, num_partitions=3
    )
    images_path = scratch_path(spark, "images")
    tables.write_table(pictures.drop("error"), images_path, overwrite=True)

    stored = tables.read_table(spark, images_path, IMAGES)
    kept = stored.filter(F.col("imgnpa").isNotNull() & has_shape("imgnpa", 32, 32))
    assert kept.count() == N - 1
    rows = kept.select(
        "accessuri",
        scale_by("imgnpa").cast("array<float>").alias("features"),
        F.col("contaminated").alias("label"),
    )
    train, test = sampling.hash_split(rows, "accessuri", [0.8, 0.2], 314)
    trainer = AveragedNetwork(
        spec=conv_spec(32, 32, 2, activation="softmax"),
        optimizer="rmsprop",
        epochs=4,
        batchSize=8,
        numWorkers=2,
        validationSplit=0.1,
        idCol="accessuri",
        precision="single",
    )
    scored = trainer.fit(train).transform(test)
    table = {row["label"]: row for row in evaluate.confusion_wide(scored, [0, 1]).collect()}
    assert table[0]["predicted_0"] + table[1]["predicted_1"] >= 0.9 * test.count()

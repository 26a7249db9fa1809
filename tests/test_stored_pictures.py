"""Payloads decoded by Spark's image source, and pictures resized by shape."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaflow.operators import images
from mediaflow.plans.pictures import picture_rows, spread
from mediaflow.sources import media
from tests.test_media import png


def tiff(pixels: np.ndarray) -> bytes:
    """Uncompressed red-green-blue TIFF in one strip."""
    height, width, _ = pixels.shape
    body = pixels.astype(np.uint8).tobytes()
    entries = [
        (256, 3, 1, width), (257, 3, 1, height), (258, 3, 3, 8 + len(body)), (259, 3, 1, 1), (262, 3, 1, 2),
        (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, height), (279, 4, 1, len(body)),
    ]
    start = 8 + len(body) + 6
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *entry) for entry in entries) + b"\0\0\0\0"
    return struct.pack("<2sHI", b"II", 42, start) + body + struct.pack("<HHH", 8, 8, 8) + directory


def jpeg(spark, grey: int, side: int) -> bytes:
    awt = spark._jvm.java.awt.image.BufferedImage(side, side, 1)
    for x in range(side):
        for y in range(side):
            awt.setRGB(x, y, grey * 0x10101)
    out = spark._jvm.java.io.ByteArrayOutputStream()
    assert spark._jvm.javax.imageio.ImageIO.write(awt, "jpg", out)
    return bytes(out.toByteArray())


def test_every_format_goes_through_one_decoder(spark):
    pixels = np.random.default_rng(3).integers(0, 256, (6, 5, 3))
    payloads = [("tiff", tiff(pixels)), ("png", png(pixels, [0] * 6)), ("png again", png(pixels, [0] * 6)), ("jpeg", jpeg(spark, 90, 8)), ("junk", b"no picture"), ("empty", b""), ("none", None)]
    rows = spark.createDataFrame([(name, content, 1) for name, content in payloads], "name string, content binary, error int")
    found = {r["name"]: r for r in media.decode_stored(rows, "content").collect()}
    assert set(found) == {name for name, _ in payloads}
    flat = pixels.astype(float).ravel().tolist()
    assert found["tiff"]["imgnpa"] == found["png"]["imgnpa"] == found["png again"]["imgnpa"] == flat
    assert len(found["jpeg"]["imgnpa"]) == 192 and set(found["jpeg"]["imgnpa"]) == {90.0}
    assert all(found[name]["imgnpa"] is None for name in ("junk", "empty", "none"))
    assert found["none"]["error"] == "no payload" and "picture" in found["junk"]["error"] and found["tiff"]["error"] is None
    small = {r["name"]: r["imgnpa"] for r in media.decode_stored(rows, "content", 3, 2).collect()}
    assert small["tiff"] == images.resize(pixels.astype(np.uint8), 3, 2).astype(float).ravel().tolist()
    assert media.decode_stored(rows.limit(0), "content").count() == 0


def test_shapes_are_resized_together_and_alike():
    draw = np.random.default_rng(5)
    shapes = [(7, 9, 3), (4, 4, 1), (7, 9, 3), (32, 8, 4), (7, 9, 3)]
    pictures = [draw.integers(0, 256, shape).astype(np.uint8) for shape in shapes]
    for height, width in ((4, 4), (7, 20), (50, 3)):
        together = images.flattened([pictures[0], None, *pictures[1:]], height, width)
        assert together[1] is None
        for one, flat in zip(pictures, [together[0], *together[2:]]):
            assert np.array_equal(images.resize(one, height, width).astype(np.float32).ravel(), flat)
    group = np.stack([pictures[0], pictures[2], pictures[4]])
    assert images.resize_group(group, 5, 6).shape == (3, 5, 6, 3)
    assert [p.dtype for p in images.flattened(pictures)] == [np.float32] * 5


def test_groups_are_cut(monkeypatch):
    pictures = [np.full((4, 4, 3), i, np.uint8) for i in range(9)]
    monkeypatch.setattr(images, "GROUP_VALUES", 100)
    assert [set(flat.tolist()) for flat in images.flattened(pictures, 2, 2)] == [{float(i)} for i in range(9)]


def test_pictures_are_dealt_out_to_every_core(spark):
    rows = spread(spark.range(1000), "id")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    counts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_picture_queries_run_in_many_tasks(spark):
    rows = picture_rows(spark, "/root/testdata/sf0.001").withColumn("part", F.spark_partition_id())
    assert rows.select("part").distinct().count() == spark.sparkContext.defaultParallelism

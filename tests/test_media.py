from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediaflow.operators import images, payload
from mediaflow.sources import media, tables
from mediaflow.storage import scratch_path
from tests.conftest import plan_of, rows_of


def png(pixels: np.ndarray, filters: int | list[int] = 0) -> bytes:
    """A PNG file of 8-bit pixels, with the given filter on each line."""
    height, width, channels = pixels.shape
    methods = [filters] * height if isinstance(filters, int) else filters
    padded = np.zeros((height + 1, width + 1, channels), np.int64)
    padded[1:, 1:] = pixels
    lines = b""
    for y in range(height):
        here, left = padded[y + 1, 1:], padded[y + 1, :-1]
        up, corner = padded[y, 1:], padded[y, :-1]
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][methods[y]]
        lines += bytes([methods[y]]) + ((here - guess) & 255).astype(np.uint8).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        crc = zlib.crc32(kind + body)
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", crc)

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", head)
        + chunk(b"IDAT", zlib.compress(lines))
        + chunk(b"IEND", b"")
    )


def noise(height: int, width: int, channels: int = 3, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, channels)).astype(np.uint8)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_with_every_line_filter(channels):
    pixels = noise(10, 7, channels)
    assert np.array_equal(images.decode(png(pixels, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])), pixels)


def test_bmp_expression_is_read_back_by_both_readers(spark):
    pixels = noise(5, 3)
    rows = spark.createDataFrame([(pixels.ravel().tolist(),), (None,), ([1, 2],)], "p array<int>")
    content = [row[0] for row in rows.select(images.bmp_bytes("p", 5, 3)).collect()]
    assert content[1:] == [None, None]
    assert np.array_equal(images.decode(bytes(content[0])), pixels)


def test_unreadable_bytes_are_reported_not_swallowed(spark):
    rows = spark.createDataFrame(
        [(1, bytearray(png(noise(4, 4)))), (2, bytearray(b"junk")), (3, None)], "id int, b binary"
    )
    found = {row["id"]: row for row in images.decode_images(rows, "b").collect()}
    assert len(found[1]["imgnpa"]) == 48 and found[1]["error"] is None
    assert found[2]["imgnpa"] is None and "ValueError" in found[2]["error"]
    assert found[3]["imgnpa"] is None and found[3]["error"] == "no reference"


def test_resize_keeps_constants_and_the_same_size():
    for shape, target in (((50, 70), (20, 90)), ((20, 20), (64, 64)), ((500, 300), (256, 256))):
        assert (images.resize(np.full((*shape, 3), 77, np.uint8), *target) == 77).all()
    same = noise(32, 32)
    assert np.array_equal(images.resize(same, 32, 32), same)


def test_resize_keeps_a_ramp_straight():
    ramp = np.repeat(np.arange(0, 256, 2, dtype=np.uint8)[None, :, None], 4, axis=0)
    small = images.resize(ramp, 4, 64)[0, 8:-8, 0].astype(int)
    assert set(np.diff(small)) <= {3, 4, 5}


def _slow_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The same kernel, one output value at a time with exact integers."""

    def kernel(x: float) -> float:
        if x == 0:
            return 1.0
        if abs(x) >= 3:
            return 0.0
        t = np.pi * x
        return 3 * np.sin(t) * np.sin(t / 3) / (t * t)

    def along(rows: np.ndarray, size: int) -> np.ndarray:
        n = rows.shape[1]
        widen = max(n / size, 1.0)
        out = np.zeros((rows.shape[0], size, rows.shape[2]), np.int64)
        for o in range(size):
            centre = (o + 0.5) * n / size
            low = max(int(centre - 3 * widen + 0.5), 0)
            high = min(int(centre + 3 * widen + 0.5), n)
            weights = [kernel((i - centre + 0.5) / widen) for i in range(low, high)]
            total = sum(weights)
            fixed = [int(w / total * 2**22 + (0.5 if w >= 0 else -0.5)) for w in weights]
            for i, w in zip(range(low, high), fixed):
                out[:, o] += rows[:, i].astype(np.int64) * w
            out[:, o] = np.clip((out[:, o] + 2**21) >> 22, 0, 255)
        return out

    wide = along(pixels, width) if pixels.shape[1] != width else pixels
    turned = wide.transpose(1, 0, 2)
    tall = along(turned, height) if pixels.shape[0] != height else turned
    return tall.transpose(1, 0, 2)


@pytest.mark.parametrize("shape, target", [((9, 13), (4, 20)), ((30, 8), (7, 8)), ((6, 6), (13, 5))])
def test_resize_equals_the_slow_form(shape, target):
    pixels = noise(*shape)
    assert np.array_equal(images.resize(pixels, *target), _slow_resize(pixels, *target))


def test_resize_pixels_gives_null_for_other_lengths(spark):
    rows = spark.createDataFrame(
        [(1, [5.0] * 48), (2, [5.0] * 16), (3, None)], "id int, p array<float>"
    )
    found = {row["id"]: row["p"] for row in images.resize_pixels(rows, "p", (4, 4), (2, 2)).collect()}
    assert found == {1: [5.0] * 12, 2: None, 3: None}


@pytest.fixture
def tree(spark, tmp_path):
    pictures = {"dog/a": noise(6, 5, seed=1), "cat/b": noise(6, 5, seed=2), "cat/c": noise(3, 3, seed=3)}
    for name, pixels in pictures.items():
        target = tmp_path / f"{name}.png"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(png(pixels))
    (tmp_path / "dog" / "junk.png").write_bytes(b"no picture")
    return tmp_path, pictures


def test_classes_come_from_folders(spark, tree):
    files = media.with_class_id(media.read_image_files(spark, str(tree[0])))
    found = rows_of(files.select("class", "class_id").distinct())
    assert found == [("cat", 0), ("dog", 1)]
    dogs = files.filter("class = 'dog'").drop("class_id")
    numbered = media.with_class_id(dogs, like=files.drop("class_id"))
    assert rows_of(numbered.select("class_id").distinct()) == [(1,)]
    with pytest.raises(Exception, match="Unseen label"):
        media.with_class_id(files.drop("class_id"), like=dogs).select("class_id").collect()
    narrow = plan_of(media.read_image_files(spark, str(tree[0])).select("class", "length"))
    assert "content" not in narrow.split("ReadSchema")[-1]


def test_image_source_gives_red_green_blue(spark, tree):
    root, pictures = tree
    rows = media.read_decoded_images(spark, str(root)).collect()
    found = {row["path"].rsplit("/", 1)[1]: row for row in rows}
    for name, pixels in pictures.items():
        row = found[name.split("/")[1] + ".png"]
        assert row["class"] == name.split("/")[0]
        assert row["imgnpa"] == pixels.astype(float).ravel().tolist()
    assert found["junk.png"]["imgnpa"] is None
    kept = media.read_decoded_images(spark, str(root), 4, 4, drop_invalid=True)
    assert [len(row["imgnpa"]) for row in kept.collect()] == [48] * 3


def test_image_source_reads_tiff_and_jpeg(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    for kind in ("tiff", "jpg"):
        raster = jvm.java.awt.image.BufferedImage(8, 8, 5)
        for x in range(8):
            for y in range(8):
                raster.setRGB(x, y, (200 << 16) + (100 << 8) + 50)
        target = jvm.java.io.File(str(tmp_path / f"p.{kind}"))
        assert jvm.javax.imageio.ImageIO.write(raster, kind, target)
    for row in media.read_decoded_images(spark, str(tmp_path)).collect():
        wanted = np.tile([200, 100, 50], 64)
        assert np.abs(np.array(row["imgnpa"]) - wanted).max() <= 3


def test_fetch_reports_missing_files(spark, tree):
    refs = spark.createDataFrame([("cat/b.png",), ("cat/none.png",), (None,)], "ref string")
    fetched = payload.fetch_payload(refs, "ref", payload.file_fetcher(f"file://{tree[0]}"))
    found = {row["ref"]: row for row in fetched.collect()}
    assert found["cat/b.png"]["payload"] == png(tree[1]["cat/b"])
    assert "FileNotFoundError" in found["cat/none.png"]["error"]
    assert rows_of(payload.failure_counts(fetched)) == [(3, 2)]


def test_one_call_per_row_also_under_a_filter(spark, tree):
    calls = spark.sparkContext.accumulator(0)
    fetch = payload.file_fetcher(f"file://{tree[0]}")

    def counted(reference: str) -> bytes:
        calls.add(1)
        return fetch(reference)

    reference = F.when(F.col("id") % 2 == 0, "cat/b.png").otherwise(F.concat(F.lit("x"), "id"))
    refs = spark.range(40).select("id", reference.alias("ref")).repartition(4, "id")
    rows = images.materialise_images(refs, "ref", counted, 4, 4, parallel=1)
    kept = rows.filter(F.col("imgnpa").isNotNull())
    assert kept.count() == 20
    # Twenty different missing references, and the repeated one once per batch.
    assert calls.value == 24


def test_latest_results_are_kept_within_bytes():
    calls: list[str] = []

    def call(argument: str) -> bytes:
        calls.append(argument)
        if argument == "bad":
            raise ValueError("no")
        return b"x" * 10

    run = payload.remembered(call, 28)
    for argument in ("a", "b", "a", "c", "a", "b"):
        assert run(argument) == b"x" * 10
    assert calls == ["a", "b", "c", "b"]
    for _ in range(2):
        with pytest.raises(ValueError):
            run("bad")
    assert calls[-2:] == ["bad", "bad"]
    assert payload.remembered(call, 0)("a") == b"x" * 10


def test_hot_reference_is_fetched_once_per_task(spark, tree):
    calls = spark.sparkContext.accumulator(0)
    fetch = payload.file_fetcher(f"file://{tree[0]}")

    def counted(reference: str) -> bytes:
        calls.add(1)
        return fetch(reference)

    refs = spark.range(1000).select(F.lit("cat/b.png").alias("ref")).coalesce(2)
    fetched = payload.fetch_payload(refs, "ref", counted)
    assert fetched.filter(F.col("error").isNull()).count() == 1000
    assert calls.value == fetched.rdd.getNumPartitions()


def test_fetch_by_url(tree):
    fetch = payload.http_fetcher(f"file://{tree[0]}/", attempts=2)
    assert fetch("cat/b.png") == png(tree[1]["cat/b"])
    with pytest.raises(OSError):
        fetch("cat/none.png")


def test_materialised_table_has_the_declared_type(spark, tree):
    refs = spark.createDataFrame([("cat/b.png", 1)], "accessuri string, contaminated int")
    rows = images.materialise_images(
        refs, "accessuri", payload.file_fetcher(f"file://{tree[0]}"), 8, 8, num_partitions=2
    )
    assert dict(rows.dtypes)["imgnpa"] == "array<float>"
    pixels = images.resize(tree[1]["cat/b"], 8, 8)
    assert rows.first()["imgnpa"] == pixels.astype(float).ravel().tolist()


def test_large_pictures_leave_in_small_batches(spark):
    sizes: list[int] = []

    def big(reference: str) -> np.ndarray:
        return np.zeros(3, np.float32)

    rows = spark.range(300).select(F.col("id").cast("string").alias("ref")).coalesce(1)
    from pyspark.sql import types as T

    mapped = payload.map_references(
        rows, "ref", big, "v", T.ArrayType(T.FloatType()), pa.list_(pa.float32()), chunk_rows=64
    )
    counted = mapped.mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"
    )
    sizes = [row["n"] for row in counted.collect()]
    assert sum(sizes) == 300


def test_attach_payload(spark):
    refs = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "k string")
    stored = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N")], "k string, v string")
    expected = [("a", "A"), ("a", "A"), ("x", None), (None, None)]
    assert rows_of(payload.attach_payload(refs, stored, "k")) == sorted(expected, key=repr)
    over = payload.attach_payload(refs, stored, "k", limit_bytes=0)
    assert rows_of(over) == sorted(expected, key=repr)
    with pytest.raises(payload.DuplicatePayload):
        payload.attach_payload(refs, stored.union(stored), "k")


def test_media_url(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "r string")
    assert rows_of(rows.select(payload.media_url("http://h/?q=", "r"))) == [("http://h/?q=a b",), (None,)]
    assert rows.select(payload.media_url("http://h/?q=", "r", encode=True)).first()[0] == "http://h/?q=a+b"


def test_lines_drop_the_header_token_anywhere(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,f1,f2,label\n1,0.5,2,A\nid,x,y,z\n2,1e3,-1,B\n")
    train = tables.load_lines(spark, str(tmp_path), shuffle_seed=1)
    assert rows_of(train) == [([0.5, 2.0], "A"), ([1000.0, -1.0], "B")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "t.csv").write_text("id,f1,f2\n7,1,2\n")
    scored = tables.load_lines(spark, str(tmp_path / "s"), train=False, vectors=True)
    row = scored.first()
    assert row["features"].toArray().tolist() == [1.0, 2.0] and row["category"] == "Class_1"


def test_bad_numbers_raise_or_become_null(spark):
    lines = spark.createDataFrame([("1,oops,2,A",)], "value string")
    parts = tables.split_lines(lines)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.labelled_features(parts).collect()
    assert rows_of(tables.labelled_features(parts, strict=False)) == [([None, 2.0], "A")]


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,f0,f1,category\n1,0.5,2,"A, or B"\nid,f0,f1,category\n')
    rows = tables.load_csv(spark, str(tmp_path / "q.csv"), 2, header=True)
    assert rows_of(rows) == [("1", [0.5, 2.0], "A, or B")]


def test_sinks(spark):
    path = scratch_path(spark, "sink")
    rows = spark.createDataFrame([(1, 0), (2, 1)], "k int, contaminated int")
    tables.write_table(rows, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(rows, path)
    tables.write_table(rows, path, overwrite=True, partition_by=["contaminated"])
    assert rows_of(tables.read_table(spark, path)) == [(1, 0), (2, 1)]

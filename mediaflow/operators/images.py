"""Pictures: decoding, resizing and flattening inside Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.functions.tensors import bound_once, has_shape, reshape_rows
from mediaflow.operators.payload import Fetcher, map_references
from mediaflow.schemas import require_columns
from mediaflow.shipping import ship_package

LANCZOS_LOBES = 3
FIXED_POINT_BITS = 22
# Values of pictures that are resized in one product.
GROUP_VALUES = 1 << 21


def decode(content: bytes) -> np.ndarray:
    """Picture bytes to a (height, width, channels) array of 8-bit values, the same on every worker.

    Uncompressed BMP and 8-bit PNG are read here. All other formats, JPEG and TIFF among them, go through Spark's own
    decoder: ``sources.media.decode_stored`` for payloads, ``sources.media.read_decoded_images`` for trees of files.
    """
    if content.startswith(b"BM"):
        return _decode_bmp(content)
    if content.startswith(b"\x89PNG\r\n\x1a\n"):
        return _decode_png(content)
    raise ValueError("not a picture format that can be read here")


def _decode_bmp(content: bytes) -> np.ndarray:
    offset, _, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", content, 10)
    if depth not in (24, 32) or packing != 0:
        raise ValueError(f"BMP with {depth} bits and packing {packing}")
    channels = depth // 8
    stride = (width * channels + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(height), offset).reshape(-1, stride)
    pixels = rows[:, : width * channels].reshape(abs(height), width, channels)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def _decode_png(content: bytes) -> np.ndarray:
    at, packed = 8, b""
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError(f"PNG with depth {depth}, colour type {colour}, interlace {interlace}")
    stride = width * channels
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, width + 1, channels), np.int64)
    for y in range(height):
        method = lines[y, 0]
        line = lines[y, 1:].reshape(width, channels).astype(np.int64)
        above = out[y, 1:]
        if method == 0:
            out[y + 1, 1:] = line
        elif method == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        elif method == 2:
            out[y + 1, 1:] = (line + above) & 255
        else:
            for x in range(width):
                left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if method == 3:
                    guess = (left + up) >> 1
                else:
                    near = left + up - corner
                    to_left, to_up, to_corner = (abs(near - v) for v in (left, up, corner))
                    guess = np.where(
                        (to_left <= to_up) & (to_left <= to_corner),
                        left,
                        np.where(to_up <= to_corner, up, corner),
                    )
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


@lru_cache(maxsize=256)
def lanczos_matrix(size_in: int, size_out: int) -> np.ndarray:
    """Fixed-point weights (size_out, size_in) of the three-lobed windowed sinc.

    Shrinking widens the kernel by the scale. Weights of an output position sum to one before they
    are rounded to fixed point.
    """
    step = size_in / size_out
    widen = max(step, 1.0)
    reach = LANCZOS_LOBES * widen
    centre = (np.arange(size_out)[:, None] + 0.5) * step
    source = np.arange(size_in)[None, :]
    first = np.maximum(np.floor(centre - reach + 0.5), 0)
    last = np.minimum(np.floor(centre + reach + 0.5), size_in)
    x = (source - centre + 0.5) / widen
    kernel = np.where(np.abs(x) < LANCZOS_LOBES, np.sinc(x) * np.sinc(x / LANCZOS_LOBES), 0.0)
    kernel = np.where((source >= first) & (source < last), kernel, 0.0)
    kernel /= kernel.sum(axis=1, keepdims=True)
    scaled = kernel * (1 << FIXED_POINT_BITS)
    return np.trunc(scaled + np.copysign(0.5, scaled)).astype(np.int64)


def resize_group(pictures: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize pictures (n, h, w, c) of one shape to exactly (height, width), rounding after each axis.

    An axis is one matrix product for all of them.
    """
    half = 1 << (FIXED_POINT_BITS - 1)

    def along(out: np.ndarray, axis: int, size: int) -> np.ndarray:
        if out.shape[axis] == size:
            return out
        # Products stay below 2**53, so the matrix product in doubles is exact.
        weights = lanczos_matrix(out.shape[axis], size).astype(np.float64)
        mixed = np.tensordot(weights, out.astype(np.float64), axes=(1, axis))
        return np.moveaxis(np.clip((mixed.astype(np.int64) + half) >> FIXED_POINT_BITS, 0, 255).astype(np.uint8), 0, axis)

    return along(along(pictures, 2, width), 1, height).astype(np.uint8)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize one picture to exactly (height, width), whatever the aspect ratio."""
    return resize_group(pixels[None], height, width)[0]


def flattened(
    pictures: list[np.ndarray | None], height: int | None = None, width: int | None = None
) -> list[np.ndarray | None]:
    """Pictures as interleaved 32-bit floats, resized if a size is given: those of one shape together."""
    out: list[np.ndarray | None] = [None] * len(pictures)
    if height is None or width is None:
        return [None if p is None else p.astype(np.float32).ravel() for p in pictures]
    shapes: dict[tuple[int, ...], list[int]] = {}
    for i, picture in enumerate(pictures):
        if picture is not None:
            shapes.setdefault(picture.shape, []).append(i)
    for shape, members in shapes.items():
        step = max(1, GROUP_VALUES // int(np.prod(shape)))
        for at in range(0, len(members), step):
            group = members[at : at + step]
            small = resize_group(np.stack([pictures[i] for i in group]), height, width)
            for i, flat in zip(group, small.reshape(len(group), -1).astype(np.float32)):
                out[i] = flat
    return out


class PictureReader:
    """Fetch and decode in one call."""

    def __init__(self, fetch: Fetcher | None) -> None:
        self.fetch = fetch

    def __call__(self, argument: str | bytes) -> np.ndarray:
        pixels = decode(argument if self.fetch is None else self.fetch(argument))
        if 0 in pixels.shape:
            raise ValueError(f"picture of shape {pixels.shape}")
        return pixels


def decode_images(
    df: DataFrame,
    content_col: str,
    output_col: str = "imgnpa",
    height: int | None = None,
    width: int | None = None,
    error_col: str = "error",
) -> DataFrame:
    """Append the pixel array of every picture; a failure gives NULL and the reason."""
    require_columns(df, [content_col])
    return _append_pixels(df, content_col, None, height, width, output_col, error_col, 1)


def materialise_images(
    df: DataFrame,
    ref_col: str,
    fetch: Fetcher,
    height: int,
    width: int,
    output_col: str = "imgnpa",
    error_col: str = "error",
    num_partitions: int | None = None,
    parallel: int = 8,
) -> DataFrame:
    """References to fixed-size pixel arrays in one pass, with no column of raw bytes between.

    ``num_partitions`` spreads the references first: the table is small next to the work on it.
    """
    require_columns(df, [ref_col])
    spread = df if num_partitions is None else df.repartition(num_partitions)
    return _append_pixels(spread, ref_col, fetch, height, width, output_col, error_col, parallel)


def _append_pixels(
    df: DataFrame,
    source_col: str,
    fetch: Fetcher | None,
    height: int | None,
    width: int | None,
    output_col: str,
    error_col: str,
    parallel: int,
) -> DataFrame:
    """Pictures are fetched and decoded one by one, then resized by shape."""

    def finish(pictures: list[np.ndarray | None]) -> list[np.ndarray | None]:
        return flattened(pictures, height, width)

    return map_references(
        df,
        source_col,
        PictureReader(fetch),
        output_col,
        T.ArrayType(T.FloatType()),
        pa.list_(pa.float32()),
        error_col,
        parallel,
        finish=finish,
    )


def flatten_rasters(
    df: DataFrame, height: int | None = None, width: int | None = None, output_col: str = "imgnpa"
) -> DataFrame:
    """Raw pictures as Spark's image source decodes them to interleaved pixel arrays.

    Reads height, width, channels and data (bytes in blue, green, red order) and replaces data by
    the array, resized if a size is given; NULL where the source could not decode the file.
    """
    at = {name: df.columns.index(name) for name in ("height", "width", "channels", "data")}

    def one(row: dict[str, pa.Scalar]) -> np.ndarray | None:
        shape = tuple(row[name].as_py() for name in ("height", "width", "channels"))
        if min(shape) <= 0:
            return None
        picture = np.frombuffer(row["data"].as_buffer(), np.uint8).reshape(shape)
        if shape[2] >= 3:
            picture = np.concatenate([picture[:, :, 2::-1], picture[:, :, 3:]], axis=2)
        return picture

    def convert(part: pa.RecordBatch) -> list[np.ndarray | None]:
        pictures = [one({name: part.column(i)[r] for name, i in at.items()}) for r in range(part.num_rows)]
        return flattened(pictures, height, width)

    return _replace_by_pixels(df, "data", output_col, convert)


def resize_pixels(
    df: DataFrame,
    pixels_col: str,
    from_shape: tuple[int, int],
    to_shape: tuple[int, int],
    channels: int = 3,
    output_col: str | None = None,
) -> DataFrame:
    """Resize interleaved pixel arrays of one known shape; other lengths and NULL give NULL."""
    require_columns(df, [pixels_col])
    at = df.columns.index(pixels_col)
    expected = from_shape[0] * from_shape[1] * channels

    def one(values: pa.ListScalar) -> np.ndarray | None:
        if not values.is_valid or len(values) != expected or values.values.null_count:
            return None
        flat = values.values.to_numpy(zero_copy_only=False)
        return np.clip(np.rint(flat), 0, 255).astype(np.uint8).reshape(*from_shape, channels)

    def convert(part: pa.RecordBatch) -> list[np.ndarray | None]:
        return flattened([one(values) for values in part.column(at)], *to_shape)

    return _replace_by_pixels(df, pixels_col, output_col or pixels_col, convert)


def _replace_by_pixels(
    df: DataFrame,
    source_col: str,
    output_col: str,
    convert: Callable[[pa.RecordBatch], list[np.ndarray | None]],
    chunk_rows: int = 64,
) -> DataFrame:
    kept = [field for field in df.schema.fields if field.name not in (source_col, output_col)]
    schema = T.StructType([*kept, T.StructField(output_col, T.ArrayType(T.FloatType()))])
    keep_at = [df.columns.index(field.name) for field in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                pixels = pa.array(convert(part), pa.list_(pa.float32()))
                columns = [part.column(i) for i in keep_at]
                yield pa.RecordBatch.from_arrays([*columns, pixels], names=schema.fieldNames())

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def bmp_bytes(pixels: str | Column, height: int, width: int) -> Column:
    """Encode interleaved red-green-blue values 0 to 255 as an uncompressed BMP file."""
    values = F.col(pixels) if isinstance(pixels, str) else pixels
    stride = width * 3
    padding = -stride % 4
    size = 54 + height * (stride + padding)
    header = struct.pack("<2sIHHI", b"BM", size, 0, 0, 54) + struct.pack(
        "<IiiHHIIiiII", 40, width, height, 1, 24, 0, size - 54, 2835, 2835, 0, 0
    )

    def body(digits: Column) -> Column:
        rows = F.reverse(reshape_rows(reshape_rows(digits, 3), width))
        lines = F.transform(
            rows,
            lambda row: F.concat(
                F.array_join(F.flatten(F.transform(row, lambda dot: F.reverse(dot))), ""),
                F.lit("00" * padding),
            ),
        )
        return F.concat(F.lit(header.hex()), F.array_join(lines, ""))

    digits = F.transform(values, lambda value: F.lpad(F.hex(value.cast("int")), 2, "0"))
    checked = F.when(has_shape(values, height, width), digits)
    return F.unhex(bound_once(checked, body))

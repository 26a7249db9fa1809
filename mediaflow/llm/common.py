"""What the operators of this subpackage share: tables, stored intermediates, hashing of byte batches."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mediaflow.storage import scratch_path

U64 = np.uint64
# Bytes of text that one NumPy pass handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 21
# A shorter pass, for steps whose workers live on beside others: less memory, and no slower.
SHORT_PASS_BYTES = 1 << 19


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
    except Exception:  # the session is gone, and its folder is the cluster's to clean
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; deleted when the driver's program ends."""
    path = scratch_path(spark, f"llm-{name}")
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and lost executors cost no recomputing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(schema: StructType, kept: list[str], ddl: str) -> StructType:
    """The fields of the kept columns, followed by further ones."""
    return StructType([*[schema[name] for name in kept], *StructType.fromDDL(ddl).fields])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one where the table already has such a column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- batches of texts as bytes -------------------------------------------------------------------


class Bytes:
    """Some rows of a text column as one byte buffer: row i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1


def byte_passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[Bytes]:
    """Cut a text column into runs of rows of at most ``limit`` bytes, or one longer row. NULL is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Bytes(row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


_PRIME = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: np.uint64, size: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < size:
        # Twice what is asked for, up to a pass: small texts, as the driver's, need no table of a whole pass.
        grown = np.full(max(size, min(2 * size, PASS_BYTES + 2)), base, np.uint64)
        grown[0] = 1
        table = _powers[kind] = np.cumprod(grown)
    return table[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits; it is one to one."""
    values = values ^ (values >> U64(32))
    values = values * U64(0xD6E8FEB86659FD93)
    values ^= values >> U64(32)
    values *= U64(0xD6E8FEB86659FD93)
    values ^= values >> U64(32)
    return values


class PrefixHash:
    """Hashes of any spans of a byte buffer, by sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray):
        size = len(data)
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power_table("up", _PRIME, size), out=self._sums[1:])
        self._down = _power_table("down", _INVERSE, size + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each position on."""
        count = max(0, len(self._sums) - width)
        return mix((self._sums[width:] - self._sums[:count]) * self._down[:count])


def word_spans(batch: Bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (one more at the end).

    A word is a run of bytes marked in ``is_word`` within one row.
    """
    inside = is_word[batch.data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = np.unique(batch.bounds)
    edges = edges[(edges > 0) & (edges < len(inside))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, batch.bounds)


STEP = U64(0xC2B2AE3D27D4EB4F)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each word on."""
    count = len(words) - width + 1
    if count <= 0:
        return words[:0]
    value = words[:count].copy()
    for i in range(1, width):
        value *= STEP
        value += words[i : i + count]
    return mix(value)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals made small."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# White space of the contracts, and the bytes of their letters-and-digits words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values

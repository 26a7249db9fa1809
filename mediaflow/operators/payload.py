"""Payloads of media references: from a stored table, or through a fetch function."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.operators.joins import BROADCAST_LIMIT_BYTES, fits_broadcast, lookup_join
from mediaflow.schemas import require_columns
from mediaflow.shipping import ship_package
from mediaflow.storage import arrow_path

Fetcher = Callable[[str], bytes]

REMEMBERED_BYTES = 64 * 1024 * 1024


class DuplicatePayload(ValueError):
    """A payload table has several rows for one reference."""


def media_url(prefix: str, reference: str | Column, encode: bool = False) -> Column:
    """Prefix + reference; NULL for a NULL reference. ``encode`` percent-encodes the reference."""
    column = F.col(reference) if isinstance(reference, str) else reference
    return F.concat(F.lit(prefix), F.url_encode(column) if encode else column)


def attach_payload(
    refs: DataFrame,
    payload: DataFrame,
    key: str,
    check_unique: bool = True,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Left join of references to a payload table: one row out per row in, NULL where none is stored."""
    require_columns(refs, [key])
    require_columns(payload, [key])
    if check_unique:
        repeated = (
            payload.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .take(5)
        )
        if repeated:
            raise DuplicatePayload(f"several payloads for {[row[0] for row in repeated]}")
    stored = payload.filter(F.col(key).isNotNull())
    if not fits_broadcast(stored, limit_bytes):
        wanted = refs.select(key).distinct()
        if fits_broadcast(wanted, limit_bytes):
            # Few references into a large store: only payloads asked for are shuffled.
            stored = stored.join(F.broadcast(wanted), key, "left_semi")
    return lookup_join(refs, stored, key, "left", limit_bytes)


# Client errors of HTTP that a later request may not meet (time-out, too early, too many requests).
PASSING_CLIENT_ERRORS = (408, 425, 429)


def is_permanent(failure: BaseException) -> bool:
    """Whether asking again is no use: the reference is refused or names nothing."""
    code = getattr(failure, "code", None)
    if isinstance(code, int):
        return 400 <= code < 500 and code not in PASSING_CLIENT_ERRORS
    reason = getattr(failure, "reason", failure)
    return isinstance(reason, (FileNotFoundError, IsADirectoryError, PermissionError, ValueError))


def http_fetcher(prefix: str = "", timeout: float = 30.0, attempts: int = 3, wait: float = 1.0) -> Fetcher:
    """Fetcher for HTTP GET of prefix + reference.

    A failure that may pass is tried again, after a wait that doubles; one that will not, such as 404, ends at once.
    """
    if attempts < 1:
        raise ValueError("attempts must be at least 1")

    def fetch(reference: str) -> bytes:
        from urllib.request import urlopen

        for attempt in range(attempts):
            try:
                with urlopen(prefix + reference, timeout=timeout) as response:
                    return response.read()
            except OSError as failure:
                if attempt + 1 == attempts or is_permanent(failure):
                    raise
                time.sleep(wait * 2**attempt)
        raise AssertionError("the loop returns or raises")

    return fetch


def file_fetcher(root: str) -> Fetcher:
    """Fetcher for files below a shared folder, given as a path or URI."""

    def fetch(reference: str) -> bytes:
        filesystem, base = arrow_path(root)
        with filesystem.open_input_stream(f"{base}/{reference}") as stream:
            return stream.read()

    return fetch


def remembered(call: Callable[[object], object], limit_bytes: int) -> Callable[[object], object]:
    """Keep the latest results of a call within a number of bytes. Failures are not kept."""
    held: OrderedDict[object, object] = OrderedDict()
    lock = Lock()
    room = limit_bytes

    def run(argument: object) -> object:
        nonlocal room
        with lock:
            if argument in held:
                held.move_to_end(argument)
                return held[argument]
        value = call(argument)
        with lock:
            if argument not in held:
                held[argument] = value
                room -= _size(argument) + _size(value)
            while room < 0:
                room += sum(map(_size, held.popitem(last=False)))
        return value

    return run


def _size(value: object) -> int:
    return value.nbytes if hasattr(value, "nbytes") else len(value)


def guarded(call: Callable[[object], object]) -> Callable[[object], tuple[object, str | None]]:
    """Turn a call that may fail into (value, None) or (None, error text)."""

    def run(argument: object) -> tuple[object, str | None]:
        if argument is None:
            return None, "no reference"
        try:
            return call(argument), None
        except Exception as failure:
            return None, f"{type(failure).__name__}: {failure}"

    return run


def map_references(
    df: DataFrame,
    ref_col: str,
    call: Callable[[str], object],
    value_col: str,
    value_type: T.DataType,
    arrow_type: pa.DataType,
    error_col: str = "error",
    parallel: int = 8,
    chunk_rows: int = 64,
    finish: Callable[[list[object]], list[object]] | None = None,
) -> DataFrame:
    """Append ``call(reference)`` and its error text to every row, in Arrow batches.

    ``finish`` turns the values of a chunk, NULL for a failure, into those that are appended.

    A reference repeated within a chunk is called once, and latest results are kept, so that a
    reference of many rows costs about one call per task. Calls run in a small thread pool, since
    they mostly wait. Values leave in chunks of ``chunk_rows`` so that large ones never pile up to
    a whole input batch.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(value_col, value_type), T.StructField(error_col, T.StringType())]
    )
    position = df.columns.index(ref_col)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe_call = guarded(remembered(call, REMEMBERED_BYTES))
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, chunk_rows):
                    chunk = batch.slice(start, chunk_rows)
                    refs = chunk.column(position).to_pylist()
                    unique = list(dict.fromkeys(refs))
                    called = list(pool.map(safe_call, unique))
                    found = [value for value, _ in called]
                    if finish is not None:
                        found = finish(found)
                    results = {ref: (value, error) for ref, value, (_, error) in zip(unique, found, called)}
                    values = pa.array([results[ref][0] for ref in refs], type=arrow_type)
                    errors = pa.array([results[ref][1] for ref in refs], type=pa.string())
                    yield pa.RecordBatch.from_arrays([*chunk.columns, values, errors], names=names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def fetch_payload(
    df: DataFrame,
    ref_col: str,
    fetch: Fetcher,
    value_col: str = "payload",
    error_col: str = "error",
    num_partitions: int | None = None,
    parallel: int = 8,
) -> DataFrame:
    """Fetch the body of every reference; a failure gives NULL and the reason in ``error_col``.

    ``num_partitions`` spreads the references first, where a small table would give few tasks.
    """
    require_columns(df, [ref_col])
    spread = df if num_partitions is None else df.repartition(num_partitions)
    return map_references(
        spread, ref_col, fetch, value_col, T.BinaryType(), pa.binary(), error_col, parallel
    )


def failure_counts(df: DataFrame, value_col: str = "payload") -> DataFrame:
    """Rows, and rows without a value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value_col).isNull()).alias("n_failed"),
    )

"""Fetching that goes on where an earlier run stopped.

What was tried is a table to which each run adds: a row for a reference and run, with the payload or the reason for
its lack. A run asks for references that were neither fetched nor have failed for good, and that have tries left.
Hosts that answer badly are left alone for a while that doubles with each failure; other hosts go on meanwhile.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.operators.joins import BROADCAST_LIMIT_BYTES, lookup_join
from mediaflow.operators.payload import Fetcher, is_permanent
from mediaflow.schemas import require_columns
from mediaflow.shipping import ship_package
from mediaflow.storage import path_exists

ATTEMPTS = (
    "reference string, run string, at timestamp, tries int, fetched boolean, permanent boolean, "
    "error string, payload binary"
)
LONGEST_WAIT = 60.0


def host_of(reference: str | Column) -> Column:
    """Host of a URL; the empty string for what has none."""
    column = F.col(reference) if isinstance(reference, str) else reference
    return F.lower(F.regexp_extract(column, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """All that was tried so far; empty before the first run."""
    if path_exists(spark, path):
        return spark.read.schema(ATTEMPTS).parquet(path)
    return spark.createDataFrame([], ATTEMPTS)


def settled(attempts: DataFrame, most_tries: int) -> DataFrame:
    """(reference) of those that are fetched, have failed for good, or were tried often enough."""
    # Payloads are not among the columns that are read for this.
    state = attempts.groupBy("reference").agg(
        F.max(F.col("fetched") | F.col("permanent")).alias("done"), F.sum("tries").alias("tries")
    )
    return state.filter(F.col("done") | (F.col("tries") >= most_tries)).select("reference")


def _ask(references: list[str], fetch: Fetcher, tries: int, wait: float, sleep: Callable[[float], None]) -> list[tuple]:
    """Ask one host for its references, one after the other; (reference, tries, payload, error, permanent)."""
    out, pause = [], 0.0
    for reference in references:
        for attempt in range(1, tries + 1):
            if pause:
                sleep(pause)
            try:
                out.append((reference, attempt, fetch(reference), None, False))
                pause = 0.0
                break
            except Exception as failure:
                permanent = is_permanent(failure)
                # An answer that will not change says nothing against the host.
                pause = 0.0 if permanent else min(LONGEST_WAIT, pause * 2 or wait)
                if permanent or attempt == tries:
                    out.append((reference, attempt, None, f"{type(failure).__name__}: {failure}", permanent))
                    break
    return out


def fetch_missing(
    refs: DataFrame,
    ref_col: str,
    fetch: Fetcher,
    path: str,
    tries: int = 2,
    most_tries: int = 10,
    wait: float = 1.0,
    tasks: int | None = None,
    tasks_per_host: int = 4,
    slices: int = 1,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    sleep: Callable[[float], None] = time.sleep,
) -> None:
    """Fetch the references that the attempts at ``path`` do not settle, each once, and add what came of it.

    A reference is tried ``tries`` times in this run and ``most_tries`` times in all. A host is asked by at most
    ``tasks_per_host`` tasks at a time, one request each. With ``slices`` the references go in so many jobs: a run that
    dies keeps the jobs that ended. NULL references are not asked for.
    """
    require_columns(refs, [ref_col])
    spark = refs.sparkSession
    ship_package(spark)
    run = uuid.uuid4().hex
    number = tasks or spark.sparkContext.defaultParallelism
    wanted = refs.select(F.col(f"`{ref_col}`").alias("reference")).filter("reference is not null").distinct()

    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_workers=8) as pool:
            for batch in batches:
                by_host: dict[str, list[str]] = defaultdict(list)
                for host, reference in zip(batch.column("host").to_pylist(), batch.column("reference").to_pylist()):
                    by_host[host].append(reference)
                for rows in pool.map(lambda refs: _ask(refs, fetch, tries, wait, sleep), by_host.values()):
                    names, counts, payloads, errors, permanent = zip(*rows)
                    yield pa.record_batch(
                        {
                            "reference": pa.array(names, pa.string()),
                            "tries": pa.array(counts, pa.int32()),
                            "fetched": pa.array([error is None for error in errors]),
                            "permanent": pa.array(permanent),
                            "error": pa.array(errors, pa.string()),
                            "payload": pa.array(payloads, pa.binary()),
                        }
                    )

    for i in range(slices):
        part = wanted.filter(F.pmod(F.xxhash64("reference"), F.lit(slices)) == i) if slices > 1 else wanted
        done = settled(read_attempts(spark, path), most_tries)
        hosted = part.join(done, "reference", "left_anti").withColumn("host", host_of("reference"))
        share = F.pmod(F.xxhash64("reference"), F.lit(tasks_per_host)).alias("share")
        asked = (
            hosted.repartition(number, "host", share)
            .mapInArrow(
                attempt,
                "reference string, tries int, fetched boolean, permanent boolean, error string, payload binary",
            )
            .select("reference", F.lit(run).alias("run"), F.current_timestamp().alias("at"), "tries", "fetched", "permanent", "error", "payload")
        )
        asked.write.mode("append").parquet(path)


def with_fetched(
    refs: DataFrame, ref_col: str, path: str, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Append ``payload`` and ``error`` from the attempts: the payload, or the reason of the last failure."""
    attempts = read_attempts(refs.sparkSession, path)
    latest = attempts.groupBy("reference").agg(
        F.max_by(F.struct("payload", "error"), F.struct("fetched", "at")).alias("last")
    )
    known = latest.select(F.col("reference").alias("__reference"), "last.payload", "last.error")
    asked = refs.withColumn("__reference", F.col(f"`{ref_col}`"))
    return lookup_join(asked, known, "__reference", "left", limit_bytes).drop("__reference")

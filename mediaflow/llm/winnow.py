"""Benchmark decontamination by winnowing.

Words are runs of letters and digits, capitals A-Z made small. Of the 5-word grams in every window of 10 words
the one with the least hash is the window's fingerprint; any span of 10 words that a document shares with an
item therefore shares a fingerprint. Documents keep a candidate where a fingerprint is one of the benchmark's;
each hit is then extended: all 10 words of the document's window are compared with the item's.

An item of 1 to 9 words is one window of its own length, compared at every position.

The benchmark is the stated query set. It is cut into blocks of at most ``BLOCK_BYTES`` of text (an item is never
cut); each block is sent to the tasks and all documents pass it once. Documents never move, so no key, passage or
frequent word can crowd a task; memory is one block and one pass of texts.

Defined cases: NULL or wordless texts have no words and hit nothing; a NULL item id is the empty string; items that share
an id are listed once, in however many blocks they lie; repeated documents each give a row; empty tables give no rows or no hits. Other columns of the
documents stay, and one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaflow.llm.common import (
    ALPHANUMERIC,
    SHORT_PASS_BYTES,
    STEP,
    Bytes,
    PrefixHash,
    byte_passes,
    extended,
    gram_hashes,
    lowered,
    mix,
    sliding_min,
    word_spans,
)
from mediaflow.shipping import ship_package

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
RESULTS = ("n_words", "hits", "items")

def word_hashes(batch: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and for each row the words before it."""
    data = lowered(batch.data)
    starts, ends, cuts = word_spans(Bytes(batch.first, data, batch.bounds), ALPHANUMERIC)
    return PrefixHash(data).spans(starts, ends), cuts


class ItemBlock:
    """Windows of some benchmark items, to be looked up by hash."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        column = pa.array([text.encode() for text in texts], pa.large_binary())
        hashes, counts = [], []
        for batch in byte_passes(column, SHORT_PASS_BYTES):
            words, cuts = word_hashes(batch)
            hashes.append(words)
            counts.append(np.diff(cuts))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        first = np.cumsum(counts) - counts
        # For each window length: sorted hashes, a place of each among the words, and the items that have it.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(int(n), WINDOW) for n in counts if n}):
            of = np.flatnonzero(counts >= WINDOW) if width == WINDOW else np.flatnonzero(counts == width)
            windows = counts[of] - width + 1
            at = np.repeat(first[of] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
            values = gram_hashes(self.words, width)[at]
            known, where, inverse = np.unique(values, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([inverse, np.repeat(of, windows)], axis=1), axis=0)
            bounds = np.searchsorted(pairs[:, 0], np.arange(len(known) + 1))
            self.tables[width] = known, at[where], pairs[:, 1], bounds
        self.prints = np.zeros(0, np.uint64)
        if WINDOW in self.tables:
            least = sliding_min(gram_hashes(self.words, GRAM), WINDOW - GRAM + 1)
            self.prints = np.unique(least[self.tables[WINDOW][1]])

    def hits(self, words: np.ndarray, cuts: np.ndarray):
        """(row, word, width, window) of every window of the rows that some item has."""
        rows = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        for width, (known, places, _, _) in self.tables.items():
            if len(words) < width:
                continue
            inside = rows[: len(rows) - width + 1] == rows[width - 1 :]
            if width == WINDOW:
                least = sliding_min(gram_hashes(words, GRAM), WINDOW - GRAM + 1)
                # Neighbouring windows mostly have the same fingerprint: look each run up once.
                new = np.append(True, least[1:] != least[:-1])
                heads = least[new]
                at = np.minimum(np.searchsorted(self.prints, heads), len(self.prints) - 1)
                run_hit = self.prints[at] == heads
                candidates = np.flatnonzero(run_hit[np.cumsum(new) - 1] & inside)
                if not len(candidates):
                    continue
                spans = words[candidates[:, None] + np.arange(width)]
                value = spans[:, 0].copy()
                for i in range(1, width):
                    value = value * STEP + spans[:, i]
                value = mix(value)
            else:
                candidates = np.flatnonzero(inside)
                value = gram_hashes(words, width)[candidates]
            at = np.minimum(np.searchsorted(known, value), len(known) - 1)
            found = np.flatnonzero(known[at] == value)
            at, candidates = at[found], candidates[found]
            same = np.ones(len(at), bool)
            for i in range(width):
                same &= words[candidates + i] == self.words[places[at] + i]
            yield rows[candidates[same]], candidates[same], width, at[same]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[ItemBlock]:
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    for name, text in rows.toLocalIterator():
        if texts and size + len(text) > BLOCK_BYTES:
            yield ItemBlock(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(name or "")
        texts.append(text)
        size += len(text)
    yield ItemBlock(ids, texts)


def _searched(documents: DataFrame, text_col: str, block: ItemBlock) -> DataFrame:
    kept = [name for name in documents.columns if name not in RESULTS]
    schema = extended(
        documents.schema, kept, "n_words bigint, hits array<struct<start:bigint,stop:bigint>>, items array<string>"
    )
    text_at = documents.columns.index(text_col)
    kept_at = [documents.columns.index(name) for name in kept]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in byte_passes(batch.column(text_at), SHORT_PASS_BYTES):
                words, cuts = word_hashes(texts)
                n = len(texts)
                spans: list[list[dict]] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                change = np.zeros(len(words) + 1, np.int64)
                pairs = []
                for rows, at, width, window in block.hits(words, cuts):
                    change += np.bincount(at, minlength=len(change)) - np.bincount(at + width, minlength=len(change))
                    seen = np.unique(np.stack([rows, window], axis=1), axis=0)
                    _, _, of, bounds = block.tables[width]
                    many = bounds[seen[:, 1] + 1] - bounds[seen[:, 1]]
                    flat = np.repeat(bounds[seen[:, 1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    pairs.append(np.stack([np.repeat(seen[:, 0], many), of[flat]], axis=1))
                for row, item in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else ():
                    items[row].append(block.ids[item])
                items = [sorted(set(names)) for names in items]
                # Runs of covered words, cut where a document ends.
                covered = np.cumsum(change)[:-1] > 0
                for row in np.flatnonzero(np.bincount(np.repeat(np.arange(n), np.diff(cuts))[covered], minlength=n)).tolist():
                    own = np.diff(np.concatenate([[0], covered[cuts[row] : cuts[row + 1]].astype(np.int8), [0]]))
                    begins, ends = np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist()
                    spans[row] = [{"start": a, "stop": b} for a, b in zip(begins, ends)]
                part = batch.slice(texts.first, n)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in kept_at], pa.array(np.diff(cuts), pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))],
                    [*kept, *RESULTS],
                )

    return documents.mapInArrow(search, schema)


def searched(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents with n_words, hits (runs of covered words, [start, stop) in words) and items (those found)."""
    ship_package(documents.sparkSession)
    passes = [_searched(documents, text_col, block) for block in _blocks(benchmark, item_col, item_text_col)]
    if len(passes) == 1:
        return passes[0]
    # Several blocks: what they found in a document comes together; equal rows are counted and given back.
    kept = [name for name in documents.columns if name not in RESULTS]
    union = passes[0].withColumn("block", F.lit(0))
    for i, more in enumerate(passes[1:], 1):
        union = union.unionByName(more.withColumn("block", F.lit(i)).filter(F.size("items") > 0))
    grouped = union.groupBy(*kept).agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum((F.col("block") == 0).cast("int")).alias("copies"),
    )
    return grouped.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def covered_words(hits: str = "hits"):
    """Number of words in the union of the hit spans."""
    return F.aggregate(
        F.array_sort(F.col(hits)),
        F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, span: F.struct(
            (acc["words"] + F.greatest(span["stop"] - F.greatest(span["start"], acc["end"]), F.lit(0))).alias("words"),
            F.greatest(acc["end"], span["stop"]).alias("end"),
        ),
        lambda acc: acc["words"],
    )

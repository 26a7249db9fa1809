"""Token counts per field: encode the whole document once, then share its tokens out by their character spans.

A document is its fields joined by a separator, as it would be trained on; encoding each field by itself would
count other tokens at the seams. The spans of the tokens (from the tokenizer's offsets) are interval-joined to
the spans of the fields; both are sorted, so this is a binary search. A separator counts to the field after it.

Tokens that cross a boundary go by an explicit rule:

    majority   to the field with most of its characters, the earlier of equals (the default)
    start      to the field of its first character
    split      to all in proportion to their characters

Defined cases: a NULL field is empty and has no token of its own; a document without any text has zero counts;
each row is a document of its own, repeated ids too; other columns are ignored. Work is row by row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaflow.llm.encoding import encoder, text_groups
from mediaflow.shipping import ship_package

RULES = ("majority", "start", "split")


def shared_out(spans: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and the number of tokens that cross a boundary. Section i is [bounds[i], bounds[i + 1])."""
    inner = bounds[1:-1]
    first = np.searchsorted(inner, spans[:, 0], side="right")
    last = np.searchsorted(inner, spans[:, 1] - 1, side="right")
    last = np.maximum(first, last)
    crossing = np.flatnonzero(first != last)
    if rule == "start":
        return np.bincount(first, minlength=len(bounds) - 1).astype(float), len(crossing)
    counts = np.bincount(np.delete(first, crossing), minlength=len(bounds) - 1).astype(float)
    for token in crossing.tolist():
        begin, end = spans[token]
        sections = np.arange(first[token], last[token] + 1)
        chars = np.minimum(end, bounds[sections + 1]) - np.maximum(begin, bounds[sections])
        if rule == "split":
            counts[sections] += chars / chars.sum()
        else:
            counts[sections[int(np.argmax(chars))]] += 1
    return counts, len(crossing)


def attributed(
    documents: DataFrame,
    id_col: str,
    fields: Sequence[str],
    tokenizer: str,
    separator: str = " ",
    rule: str = "majority",
) -> DataFrame:
    """(id, field, n_chars, n_tokens, n_crossing) for every document and field.

    ``n_chars`` is the field's own length, ``n_crossing`` the boundary-crossing tokens of the whole document.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship_package(documents.sparkSession)
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer, True) as loaded:
            yield from counted(batches, loaded.encode)

    def counted(batches: Iterator[pa.RecordBatch], encode) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            values = [[text or "" for text in batch.column(1 + i).to_pylist()] for i in range(len(names))]
            joined = [separator.join(parts) for parts in zip(*values)]
            for first, texts in text_groups(joined):
                _, counts, spans = encode(texts)
                ends = np.cumsum(counts)
                chars, tokens, crossing = [], [], []
                for i in range(len(texts)):
                    lengths = [len(column[first + i]) for column in values]
                    bounds = np.cumsum([0, lengths[0], *[len(separator) + n for n in lengths[1:]]])
                    shares, crossed = shared_out(spans[ends[i] - counts[i] : ends[i]], bounds, rule)
                    chars += lengths
                    tokens.append(shares)
                    crossing += [crossed] * len(names)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(first, n).take(pa.array(np.repeat(np.arange(n), len(names)))),
                        pa.array(names * n, pa.string()),
                        pa.array(chars, pa.int64()),
                        pa.array(np.concatenate(tokens), pa.float64()),
                        pa.array(crossing, pa.int64()),
                    ],
                    ["id", "field", "n_chars", "n_tokens", "n_crossing"],
                )

    picked = documents.select(
        F.col(id_col).cast("bigint").alias("id"), *[F.col(name).cast("string").alias(f"f{i}") for i, name in enumerate(names)]
    )
    return picked.mapInArrow(count, "id bigint, field string, n_chars bigint, n_tokens double, n_crossing bigint")

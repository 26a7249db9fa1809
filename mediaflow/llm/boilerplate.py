"""Main text of web pages: what markup cannot settle, the suffixes of each host's pages do.

Every page is cut into blocks. Those inside an article element are its text, whole, even where other pages carry
the same article. Where a page has none, its text is what no other pages of the host repeat: the token streams of
the host's pages (all but their articles) are one long text, whose suffixes are sorted by their first ``SPAN``
tokens; neighbours in that order with equal prefixes from ``PAGES`` or more distinct pages are a repeated
substring, every token under one is boilerplate, and the unique runs between them are kept. A block shorter than
``SPAN`` is one substring with its ends.

Spark does the sorting: suffixes are dealt out by the hash of host and prefix, which brings equal prefixes
together as a suffix array would, without a task for a host. They are counted per page before the shuffle, and in
tasks before it too, so a line on every page of a large host is a row per task.

Defined cases: NULL or empty pages have empty text; a page whose url is NULL or names no host is a host of its own; pages
with one html are one page to the counting, whatever their ids and urls, yet each gives a row: copies of a page are no
evidence against its text. Other columns are ignored. A page is one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaflow.llm.common import NOT_SPACE, STEP, Bytes, PrefixHash, gram_hashes, mix, stored, word_spans
from mediaflow.llm.markup import ARTICLE, FURNITURE, blocks
from mediaflow.shipping import ship_package

SPAN, PAGES = 8, 3
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def prefixes(texts: list[str], host: str) -> list[np.ndarray]:
    """For each block, the hashes of its suffixes' first ``SPAN`` tokens, or of the whole of a shorter block."""
    data = [text.encode() for text in texts]
    bounds = np.cumsum([0, *map(len, data)])
    batch = Bytes(0, np.frombuffer(b"".join(data), np.uint8), bounds)
    starts, ends, cuts = word_spans(batch, NOT_SPACE)
    tokens = PrefixHash(batch.data).spans(starts, ends)
    own = np.frombuffer(host.encode(), np.uint8)
    salt = PrefixHash(own).spans(np.array([0]), np.array([len(own)]))[0]
    long = gram_hashes(tokens, SPAN)
    found = []
    for begin, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if stop - begin >= SPAN:
            values = long[begin : stop - SPAN + 1]
        else:
            value = np.full(1, stop - begin, np.uint64)
            for token in tokens[begin:stop]:
                value = value * STEP + token
            values = mix(value)
        found.append(mix(values ^ salt))
    return found


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, page, content, text, blocks, at, prefix, seen): text where markup settled it, else the blocks and their
    suffixes; seen has the distinct suffixes of everything but articles."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: dict[str, list] = {name: [] for name in ("text", "blocks", "at", "prefix", "seen")}
                for url, content, page in zip(*(part.column(i).to_pylist() for i in (1, 3, 4))):
                    host = host_of(url) or f"\0{content}"
                    cut = blocks(page or "")
                    article = [block.text for block in cut if block.kind == ARTICLE]
                    others = [block for block in cut if block.kind != ARTICLE]
                    hashed = prefixes([block.text for block in others], host) if others else []
                    out["seen"].append(np.unique(np.concatenate(hashed)).view(np.int64) if hashed else [])
                    open_ = [(block.text, values) for block, values in zip(others, hashed) if block.kind != FURNITURE]
                    if article or not open_:
                        out["text"].append("\n\n".join(article))
                        open_ = []
                    else:
                        out["text"].append(None)
                    out["blocks"].append([text for text, _ in open_])
                    out["at"].append(np.concatenate([np.arange(len(v)) * len(open_) + i for i, (_, v) in enumerate(open_)]) if open_ else [])
                    out["prefix"].append(np.concatenate([v for _, v in open_]).view(np.int64) if open_ else [])
                longs = pa.list_(pa.int64())
                types = {"text": pa.string(), "blocks": pa.list_(pa.string()), "at": longs, "prefix": longs, "seen": longs}
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], *[pa.array(out[name], types[name]) for name in out]],
                    ["page_id", "url", "page", "content", *out],
                )

    return pages.mapInArrow(
        parse,
        "page_id bigint, url string, page bigint, content bigint, text string, blocks array<string>, at array<bigint>, "
        "prefix array<bigint>, seen array<bigint>",
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the covered tokens of the blocks; what remains of a block are its unique runs."""
    for batch in batches:
        texts = []
        for cut, covered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            hit: dict[int, set[int]] = {}
            for place in covered or ():
                hit.setdefault(place % len(cut), set()).add(place // len(cut))
            kept = []
            for i, text in enumerate(cut):
                tokens = text.split(" ")
                gone = np.zeros(len(tokens) + SPAN, bool)
                for start in hit.get(i, ()):
                    gone[start : start + SPAN] = True
                run = " ".join(token for token, drop in zip(tokens, gone.tolist()) if not drop)
                if run:
                    kept.append(run)
            texts.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row."""
    ship_package(pages.sparkSession)
    picked = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.xxhash64(id_col, url_col, html_col).alias("page"),
        F.xxhash64(html_col).alias("content"),
        F.col(html_col).alias("html"),
    )
    parsed = stored(_parsed(picked), "blocks")
    # Copies of a page count once.
    seen = parsed.select("content", F.explode("seen").alias("prefix")).distinct()
    repeated = seen.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES).select("prefix")
    unsettled = parsed.filter("text is null")
    covered = (
        unsettled.select("page", F.explode(F.arrays_zip("prefix", "at")).alias("s"))
        .select("page", F.col("s.prefix").alias("prefix"), F.col("s.at").alias("at"))
        .join(repeated, "prefix")
        .groupBy("page")
        .agg(F.collect_set("at").alias("covered"))
    )
    cleaned = (
        unsettled.join(covered, "page", "left")
        .select("page_id", "url", "blocks", "covered")
        .mapInArrow(_without, "page_id bigint, url string, text string")
    )
    return parsed.filter("text is not null").select("page_id", "url", "text").unionByName(cleaned)

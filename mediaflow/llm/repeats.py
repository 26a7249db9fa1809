"""Removing long repeated byte strings across a corpus, exactly, with run-length indexes over what may repeat.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document with a smaller id, or
before in the same one. Texts are UTF-8 bytes; matches never leave a document.

1. Documents with equal texts are one class; all but its first are repeats as a whole and drop out.
2. Every window of ``LENGTH`` bytes is named by the least hash among its ``GRAM``-byte grams, so equal windows have
   equal names; neighbouring windows of one name are a stretch, about one for each 45 bytes. Names that stand for one stretch
   alone cannot repeat. One shuffle of names finds the others by sorting; a name's rows are streamed, never held.
3. The bytes of the stretches left, about a tenth, are dealt out by name: equal windows meet in one task. There the
   texts of the stretches are indexed by a run-compressed transform and matched by streaming: of each name's
   different stretches, in document order, halves of pairs, of fours, of eights and so on are indexed, and the
   other halves stream through, so each stretch meets all before it in as many passes as the logarithm of
   their number. Symbols carry the number of the pair, since only the own half counts. Windows whose hash is unique
   in their name stay out of it: they are no repeats, and most windows under a frequent phrase are of that kind.
4. Windows whose matching statistic reaches ``LENGTH`` are repeats; their bytes are taken out.

Equal stretches are found before the index is built, in tasks before the shuffle and again behind it, so what
many documents share is indexed once.

Defined cases: NULL is empty; texts shorter than ``LENGTH`` never change; rows equal in id and text are one document,
whose places are never copies of themselves, and each gets its result; rows with one id count in the order of a hash of the text; NULL ids come first. Other
columns are ignored. Whole copies are told by 128 bits of hash. Names and the texts that stretches are cut from go by
64 bits, which only choose candidates: bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaflow.llm.common import STEP, PrefixHash, byte_passes, mix, sliding_min, stored
from mediaflow.llm.runindex import RunIndex
from mediaflow.shipping import ship_package

LENGTH, GRAM = 100, 20
WIDTH = LENGTH - GRAM + 1
# Bytes of stretches that one index is built over, where one name has no more.
INDEX_BYTES = 1 << 20
# Windows of a stretch that stream as one pattern; longer ones are cut.
PIECE = 256
SECOND_HASH = 20241


def stretches(data: np.ndarray, bounds: np.ndarray):
    """(name, row, start, windows, again) of every stretch; starts count from the row's first byte.

    ``again``: the name's gram stands in several places here, so the stretch may repeat within itself.
    """
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool))
    grams = PrefixHash(data).grams(GRAM)
    least = sliding_min(grams, WIDTH)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= bounds[1:][row]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new & inside)
    # A stretch ends where the next one starts or the row's last window is over.
    stop = np.append(np.flatnonzero(new), len(least))
    stop = stop[np.searchsorted(stop, head, side="right")]
    stop = np.minimum(stop, bounds[row[head] + 1] - LENGTH + 1)
    names = least[head]
    # Grams that are the least of some window around them.
    most = np.full(len(grams), 0, np.uint64)
    padded = np.concatenate([np.zeros(WIDTH - 1, np.uint64), least, np.zeros(WIDTH - 1, np.uint64)])
    most[:] = ~sliding_min(~padded, WIDTH)
    values, counts = np.unique(grams[most == grams], return_counts=True)
    many = values[counts > 1]
    again = many[np.minimum(np.searchsorted(many, names), len(many) - 1)] == names if len(many) else np.zeros(len(names), bool)
    return names, row[head], head - bounds[row[head]], stop - head, again


def _named(documents: DataFrame) -> DataFrame:
    """(name, h, start, windows): windows is negative where the stretch may repeat within itself."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            for texts in byte_passes(batch.column(1)):
                names, rows, starts, windows, again = stretches(texts.data, texts.bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.view(np.int64)),
                        pa.array(hashes[texts.first + rows]),
                        pa.array(starts.astype(np.int32)),
                        pa.array(np.where(again, -windows, windows).astype(np.int32)),
                    ],
                    ["name", "h", "start", "windows"],
                )

    return documents.select("h", "text").mapInArrow(name, "name bigint, h bigint, start int, windows int")


def _shared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (name, h, start), those whose name has another stretch, equal rows once."""
    fields = ["name", "h", "start", "windows"]
    held = np.zeros((0, 4), np.int64)
    held_shared = False
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
        if not len(rows):
            continue
        rows = np.concatenate([held, rows])
        new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        rows = rows[new]
        same = rows[1:, 0] == rows[:-1, 0]
        shared = np.append(same, False) | np.append(False, same) | (rows[:, 3] < 0)
        shared[0] |= held_shared
        # The last row waits for what follows.
        held, held_shared = rows[-1:], bool(shared[-1])
        kept = rows[:-1][shared[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(4)], fields)
    if len(held) and held_shared:
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(4)], fields)


_STRETCH = "name bigint, doc bigint, h bigint, start bigint, windows bigint, again boolean, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches. Of equal ones in a batch the first keeps them; the others, without, are repeats."""
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            found: dict[tuple[int, bytes], tuple] = {}
            out: list[tuple] = []
            for doc, h, text, places in zip(*(part.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                for place in places:
                    name, start, windows = place["name"], place["start"], place["windows"]
                    count = abs(windows)
                    content = data[start : start + count + LENGTH - 1]
                    if len(content) < count + LENGTH - 1:
                        # A place of another text with this one's hash.
                        continue
                    row = (name, doc, h, start, count, windows < 0, content)
                    known = found.get((name, content))
                    if known is None:
                        found[name, content] = row
                        continue
                    if known[1:4] == row[1:4]:
                        # A row of the table that is there twice: one place is no copy of itself.
                        continue
                    later, earlier = sorted((row, known), key=lambda r: r[1:4], reverse=True)
                    found[name, content] = earlier
                    out.append((*later[:6], None))
            out += found.values()
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, types)],
                ["name", "doc", "h", "start", "windows", "again", "bytes"],
            )


class _Stretches:
    """The stretches of some names side by side: bytes in one array, windows in another, numbered through."""

    def __init__(self, groups: list[list[bytes]]):
        contents = [content for group in groups for content in group]
        sizes = np.array([len(content) for content in contents], np.int64)
        self.data = np.frombuffer(b"".join(contents), np.uint8)
        self.windows = sizes - LENGTH + 1
        # First window of each stretch, and where each window starts in the bytes.
        self.first = np.cumsum(self.windows) - self.windows
        self.of = np.repeat(np.arange(len(contents)), self.windows)
        self.at = np.repeat(np.cumsum(sizes) - sizes - self.first, self.windows) + np.arange(len(self.of))
        self.hashes = PrefixHash(self.data).grams(LENGTH)[self.at]
        counts = np.array([len(group) for group in groups], np.int64)
        self.group = np.repeat(np.arange(len(groups)), counts)
        self.members = np.repeat(counts, counts)
        self.nth = np.arange(len(contents)) - np.repeat(np.cumsum(counts) - counts, counts)

    def shared(self) -> np.ndarray:
        """Windows that have the hash of another window of their name. All others are unique."""
        keys = mix(self.hashes + self.group[self.of].astype(np.uint64) * STEP)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return counts[inverse] > 1

    def inside(self, among: np.ndarray) -> np.ndarray:
        """Those among the windows that stand before in their own stretch; hashes propose, bytes decide."""
        chosen = np.flatnonzero(among)
        keys = mix(self.hashes[chosen] + self.of[chosen].astype(np.uint64) * STEP)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        earlier = chosen[first[inverse]]
        later, earlier = chosen[earlier < chosen], earlier[earlier < chosen]
        found = np.zeros(len(self.of), bool)
        places = np.arange(LENGTH)
        for i in range(0, len(later), 4096):
            one, other = (self.at[w[i : i + 4096], None] + places for w in (later, earlier))
            found[later[i : i + 4096]] = (self.data[one] == self.data[other]).all(axis=1)
        return found

    def runs(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last but one windows of the runs of marked ones, which end with their stretch."""
        head, tail = marks.copy(), marks.copy()
        head[1:] &= ~marks[:-1]
        tail[:-1] &= ~marks[1:]
        head[self.first] = marks[self.first]
        tail[self.first[1:] - 1] = marks[self.first[1:] - 1]
        tail[-1:] = marks[-1:]
        return np.flatnonzero(head), np.flatnonzero(tail) + 1

    def symbols(self, begin: np.ndarray, stop: np.ndarray, half: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes under runs of windows, one after another with ``gap`` zeros behind each, and where each begins.

        Symbols carry the number of the pair of halves that a stretch is in.
        """
        lengths = stop - begin + LENGTH - 1
        bounds = np.append(0, np.cumsum(lengths + gap))
        out = np.zeros(bounds[-1], np.int64)
        run = np.repeat(np.arange(len(begin)), lengths)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        pair = self.nth[self.of[begin]] // (2 * half)
        out[bounds[run] + inner] = self.data[self.at[begin][run] + inner] + 256 * pair[run] + 1
        return out, bounds


def _found(groups: list[list[bytes]], again: list[list[bool]]) -> tuple[_Stretches, np.ndarray]:
    """The stretches, and which of all their windows stand in an earlier one of the name or before in their own."""
    all_ = _Stretches(groups)
    # Windows that no other shares a hash with are neither indexed nor streamed.
    shared = all_.shared()
    own = np.array([flag for group in again for flag in group], bool)
    found = all_.inside(shared & own[all_.of])
    half = 1
    while all_.members.max(initial=0) > half:
        # What is found already stands earlier in the same half: that is neither sought nor shown again.
        begin, stop = all_.runs(shared & ~found)
        nth, members = all_.nth[all_.of[begin]], all_.members[all_.of[begin]]
        first = nth // half % 2 == 0
        shown = first & ((nth // half + 1) * half < members)
        sought = np.flatnonzero(~first & (members > half))
        if shown.any() and len(sought):
            pieces = -(-(stop[sought] - begin[sought]) // PIECE)
            run = np.repeat(sought, pieces)
            nth_piece = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = begin[run] + nth_piece * PIECE
            tail = np.minimum(head + PIECE, stop[run])
            index = RunIndex(all_.symbols(begin[shown], stop[shown], half, 1)[0])
            streamed, bounds = all_.symbols(head, tail, half, 0)
            matched = index.matching_statistics(streamed, bounds) >= LENGTH
            windows = tail - head
            inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            found[np.repeat(head, windows) + inner] |= matched[np.repeat(bounds[:-1], windows) + inner]
        half *= 2
    return all_, found


def repeated_windows(groups: list[list[bytes]], again: list[list[bool]]) -> list[list[np.ndarray]]:
    """For each group of different stretches in order: which windows of each stand in an earlier one or before in it."""
    if not groups:
        return []
    all_, found = _found(groups, again)
    parts = iter(np.split(found, all_.first[1:]))
    return [[next(parts) for _ in group] for group in groups]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, h, begin, stop) of the repeated bytes, from stretches sorted by name and then document order."""
    contents: list[list[bytes]] = []
    owners: list[list[tuple[int, int, int]]] = []
    flags: list[list[bool]] = []
    copies: list[tuple[int, int, int, int]] = []
    seen: dict[bytes, tuple[int, int, int]] = {}
    name = None
    size = 0

    def flushed() -> pa.RecordBatch:
        parts = [np.array(copies, np.int64).reshape(-1, 4)]
        chosen = [g for g, group in enumerate(contents) if len(group) > 1 or flags[g][0]]
        if chosen:
            all_, found = _found([contents[g] for g in chosen], [flags[g] for g in chosen])
            begin, stop = all_.runs(found)
            of = all_.of[begin]
            owner = np.array([place for g in chosen for place in owners[g]], np.int64)[of]
            shift = owner[:, 2] - all_.first[of]
            parts.append(np.stack([owner[:, 0], owner[:, 1], shift + begin, shift + stop - 1 + LENGTH], axis=1))
        rows = np.concatenate(parts)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], ["doc", "h", "begin", "stop"])

    for batch in batches:
        for row_name, doc, h, start, windows, again, content in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if row_name != name:
                if size >= INDEX_BYTES:
                    yield flushed()
                    contents, owners, flags, copies, size = [], [], [], [], 0
                name, seen = row_name, {}
                contents.append([])
                owners.append([])
                flags.append([])
            first = seen.setdefault(content, (doc, h, start))
            if first != (doc, h, start):
                copies.append((doc, h, start, start + windows - 1 + LENGTH))
                continue
            if owners[-1] and owners[-1][-1] == first:
                # The place comes once for each row that holds it.
                continue
            contents[-1].append(content)
            owners[-1].append((doc, h, start))
            flags[-1].append(again)
            size += len(content)
    yield flushed()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            sizes, spans, kept = [], [], []
            for text, whole, parts in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                data = np.frombuffer(text.encode(), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if whole and len(data) >= LENGTH:
                    change[0], change[-1] = 1, -1
                for span in parts or ():
                    change[span["begin"]] += 1
                    change[span["stop"]] -= 1
                gone = np.cumsum(change)[:-1] > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                begins, stops = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in zip(begins, stops)])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the removed runs in bytes, and the bytes that remain."""
    ship_package(documents.sparkSession)
    keyed = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumns(
        {
            "doc": F.coalesce("doc_id", F.lit(-(2**63))),
            "h": F.xxhash64("text"),
            "g": F.xxhash64(F.lit(SECOND_HASH), F.col("text")),
        }
    )
    classes = keyed.groupBy("h", "g").agg(F.min("doc").alias("first_doc"))
    names = _named(keyed).repartition("name").sortWithinPartitions("name", "h", "start")
    shared = stored(names.mapInArrow(_shared_names, "name bigint, h bigint, start bigint, windows bigint"), "stretches")
    places = (
        shared.groupBy("h")
        .agg(F.collect_list(F.struct("name", "start", "windows")).alias("places"))
        .join(classes, "h")
        .select("h", "places", F.col("first_doc").alias("doc"))
    )
    # Only the first document of a class is cut; where the table holds it twice, its places come twice.
    texts = keyed.select("doc", "h", "text")
    cut = places.join(texts, ["doc", "h"]).select("doc", "h", "text", "places").mapInArrow(_cut, _STRETCH)
    cut = stored(cut, "bytes")
    parted = cut.filter("bytes is not null").repartition("name").sortWithinPartitions("name", "doc", "h", "start")
    ranges = parted.mapInArrow(_resolved, "doc bigint, h bigint, begin bigint, stop bigint").unionByName(
        cut.filter("bytes is null").select("doc", "h", F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + LENGTH).alias("stop"))
    )
    ranges = stored(ranges, "ranges").groupBy("doc", "h").agg(F.collect_list(F.struct("begin", "stop")).alias("parts"))
    return (
        keyed.join(classes, ["h", "g"])
        .join(ranges, ["doc", "h"], "left")
        .select("doc_id", "text", (F.col("doc") != F.col("first_doc")).alias("whole"), "parts")
        .mapInArrow(_removed, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    )

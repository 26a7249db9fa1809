"""How far the sources of each language are apart, by bitmaps over counts.

A group is a (language, source). A term's probability in a group depends on its count there alone, so a group is fully
told by its levels: for each count, the set of terms that occur that often. Sets are bitmaps: the kept terms of a
language get places, most frequent first, 64 to a word, and a level is a row (word, source, count, bits). For two
groups, AND and a population count of two levels' bits give a joint cell: in how many terms the one count meets the
other. The divergence of the pair is the sum over cells of that number times f of the two probabilities. Terms that a
group lacks are its level 0: the complement of its other levels in each word.

Terms are places by frequency so that a word's terms have like counts: rare terms have few levels, and a word never has
more than 64 levels of one source. All arithmetic is on whole numbers and exact.

Documents are counted in Arrow batches: each task sums what it has read by (language, source, term) before anything is
shuffled, so the most frequent term costs a row for each task and source. Terms are compared as text, not by hash.

Defined cases: NULL text, lang and source are ''. Rows that share an id are documents of their own. A text without
terms still makes its group occur. A language without kept terms gives pairs of value 0 and no terms. Very long
texts are one pass of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import Bytes, byte_passes, lowered, stored, word_spans
from mediaflow.shipping import ship_package

SCALE_DIGITS = 9
WORD = 64
TOP_TERMS = 200
# Bytes of text counted at a time, and rows of counts that a task holds before it sends them on.
COUNT_BYTES = 8 << 20
HELD_ROWS = 1 << 21
# Cells of two groups' levels that are in memory at a time.
CELLS = 1 << 20
# The bytes of the contract's terms, once capitals are small.
TERM = np.zeros(256, bool)
TERM[0x61:0x7B] = TERM[0x80:] = True


# --- counting ------------------------------------------------------------------------------------


def _terms(batch: Bytes) -> tuple[pa.Array, np.ndarray]:
    """All terms of a pass in order, and for each row the number of terms before it."""
    data = lowered(batch.data)
    starts, ends, cuts = word_spans(Bytes(batch.first, data, batch.bounds), TERM)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = data[TERM[data]]
    terms = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inside))]
    )
    return terms, cuts


def _pass_counts(batch: Bytes, groups: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of a pass; ``groups`` numbers the group of each row."""
    terms, cuts = _terms(batch)
    coded = terms.dictionary_encode()
    size = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(batch)), np.diff(cuts))
    pairs, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
    keys = groups[pairs // size] * size + pairs % size
    order = np.argsort(keys, kind="stable")
    known, first = np.unique(keys[order], return_index=True)
    return pa.table(
        {
            "group": known // size,
            "term": coded.dictionary.take(pa.array(known % size)),
            "n": np.add.reduceat(n[order], first) if len(known) else np.zeros(0, np.int64),
            "docs": np.diff(np.append(first, len(order))),
        }
    )


def _summed(tables: list[pa.Table]) -> pa.Table:
    by = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False)
    return by.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["group", "term", "n", "docs"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0

    def labelled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        known = list(names)
        group = pa.array(table["group"].to_numpy())
        lang, source = (pa.array([name[i] for name in known], pa.string()).take(group) for i in (0, 1))
        term = table["term"].combine_chunks().cast(pa.string())
        for at in range(0, len(table), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.record_batch(
                {
                    "lang": lang[part],
                    "source": source[part],
                    "term": term[part],
                    "n": table["n"].combine_chunks()[part],
                    "docs": table["docs"].combine_chunks()[part],
                }
            )

    for batch in batches:
        lang, source = (batch.column(name).fill_null("").to_pylist() for name in ("lang", "source"))
        groups = np.array([names.setdefault(key, len(names)) for key in zip(lang, source)], np.int64)
        for part in byte_passes(batch.column("text"), COUNT_BYTES):
            table = _pass_counts(part, groups[part.first : part.first + len(part)])
            held.append(table)
            rows += len(table)
            if rows > HELD_ROWS:
                total = _summed(held)
                held, rows = [total], len(total)
                if rows > HELD_ROWS // 2:
                    yield from labelled(total)
                    held, rows = [], 0
    if held:
        yield from labelled(_summed(held))
    if names:
        lang, source = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
        zero = pa.array(np.zeros(len(names), np.int64))
        yield pa.record_batch({"lang": lang, "source": source, "term": pa.nulls(len(names), pa.string()), "n": zero, "docs": zero})


def term_counts(documents: DataFrame, min_documents: int = 3) -> DataFrame:
    """(lang, source, term, n, total, first): counts of the terms that a language keeps, and one row with a NULL term
    for each group. ``total`` is the count in the language; one row of each term has ``first``."""
    ship_package(documents.sparkSession)
    partial = documents.select("lang", "source", "text").mapInArrow(
        _count_terms, "lang string, source string, term string, n bigint, docs bigint"
    )
    # One exchange serves the sums and the totals of a term.
    counts = (
        partial.repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    whole = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("documents", F.sum("docs").over(whole))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("first", F.col("source") == F.min("source").over(whole))
        .filter(F.col("term").isNull() | (F.col("documents") >= min_documents))
        .select("lang", "source", "term", "n", "total", "first")
    )


def group_sizes(counts: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, n_terms): occurrences in each group and language, kept terms of the language."""
    groups = counts.groupBy("lang", "source").agg(
        F.sum("n").alias("size"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("firsts")
    )
    languages = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("firsts").alias("n_terms"))
    return groups.drop("firsts").join(languages, "lang")


def probability(count: Column, size: Column, n_terms: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (size + n_terms)), by long division so that no product overflows."""
    whole = size + n_terms
    rest, digits = count + 1, F.lit(0).cast("bigint")
    for _ in range(SCALE_DIGITS // 3):
        digits = digits * 1000 + F.call_function("div", rest * 1000, whole)
        rest = rest * 1000 % whole
    return digits + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- terms that a source has more of than its language --------------------------------------------


def leading_terms(counts: DataFrame, sizes: DataFrame, limit: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) for the terms that stand out most in each group."""
    found = counts.filter("term is not null and n > 0").join(sizes, ["lang", "source"])
    valued = found.select(
        "lang",
        "source",
        F.col("term").alias("item"),
        probability(F.col("n"), F.col("size"), F.col("n_terms")).alias("p"),
        probability(F.col("total"), F.col("lang_size"), F.col("n_terms")).alias("q"),
    ).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (
        valued.select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )


# --- bitmaps -------------------------------------------------------------------------------------


def _place_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by language, then by term; a word belongs to one language and one partition."""
    base = TaskContext.get().partitionId() << 40
    last, place, word = (None, None), WORD, -1
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        new_lang, new_term = np.ones(n, bool), np.ones(n, bool)
        new_lang[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
        new_term[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        new_lang[0], new_term[0] = lang[0].as_py() != last[0], term[0].as_py() != last[1]
        new_term |= new_lang
        last = (lang[n - 1].as_py(), term[n - 1].as_py())
        words, places = np.empty(n, np.int64), np.empty(n, np.int64)
        # Runs of one language; a new one starts a new word.
        starts = np.union1d([0], np.flatnonzero(new_lang))
        for at, end in zip(starts, np.append(starts[1:], n)):
            if new_lang[at]:
                word, place = word + 1, -1
            at_place = place + np.cumsum(new_term[at:end])
            words[at:end], places[at:end] = word + at_place // WORD, at_place % WORD
            word, place = int(words[end - 1]), int(places[end - 1])
        source, count = batch.column("source").dictionary_encode(), batch.column("n").to_numpy()
        code = source.indices.to_numpy()
        order = np.lexsort((count, code, words))
        w, c, k = words[order], code[order], count[order]
        edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1]) | (k[1:] != k[:-1])]))
        bits = np.bitwise_or.reduceat(np.uint64(1) << places[order].astype(np.uint64), edge)
        yield pa.record_batch(
            {
                "lang": lang.take(pa.array(order[edge])),
                "word": w[edge] + base,
                "source": source.dictionary.take(pa.array(c[edge])),
                "count": k[edge],
                "bits": bits.view(np.int64),
            }
        )


def count_bitmaps(counts: DataFrame) -> DataFrame:
    """(lang, word, source, count, bits): which of a word's 64 terms a source has so many times.

    Rows of equal lang, word, source and count may come in two parts without a common bit.
    """
    order = ["lang", F.col("total").desc(), "term"]
    placed = counts.filter("term is not null and n > 0").select("lang", "total", "term", "source", "n")
    return (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order, "source")
        .select("lang", "term", "source", "n")
        .mapInArrow(_place_terms, "lang string, word bigint, source string, count bigint, bits bigint")
    )


def _whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with a word's last row."""
    carry = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        word = table["word"].to_numpy()
        cut = int(np.flatnonzero(word != word[-1])[-1]) + 1 if word[0] != word[-1] else 0
        carry = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if carry is not None:
        yield carry


def _word_cells(code: np.ndarray, p: np.ndarray, count: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sources of one word, and for each two of them the sum over joint cells of their size times f."""
    order = np.argsort(code, kind="stable")
    code, p, count, bits = code[order], p[order], count[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    # A zero level comes as the whole word; what its source has is taken out.
    own = np.bitwise_or.reduceat(np.where(count > 0, bits, np.uint64(0)), first)
    zero = count == 0
    bits[zero] &= ~own[np.searchsorted(first, np.flatnonzero(zero), side="right") - 1]
    sums = np.empty((len(first), len(code)), np.int64)
    step = max(1, CELLS // len(code))
    for i, (at, end) in enumerate(zip(first, np.append(first[1:], len(code)))):
        total = np.zeros(len(code), np.int64)
        for a in range(at, end, step):
            b = min(end, a + step)
            joint = np.bitwise_count(bits[a:b, None] & bits).astype(np.int64)
            gap = p[a:b, None] - p
            total += (joint * (gap * gap // p)).sum(axis=0)
        sums[i] = total
    return code[first], np.add.reduceat(sums, first, axis=1)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, dict[tuple[str, str], int]] = {}
    for table in _whole_words(batches):
        word = table["word"].to_numpy()
        langs = table["lang"].to_pylist()
        source = table["source"].combine_chunks().dictionary_encode()
        names, code = source.dictionary.to_pylist(), source.indices.to_numpy()
        p, count = table["p"].to_numpy(), table["count"].to_numpy()
        bits = table["bits"].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        # All words of a run of one language add up in one matrix over the names of this table.
        matrix, seen = np.zeros((len(names), len(names)), np.int64), None
        for at, end in [*zip(first, np.append(first[1:], len(word))), (None, None)]:
            lang = None if at is None else langs[at]
            if seen is not None and lang != seen:
                into = sums.setdefault(seen, {})
                for a, b in zip(*np.nonzero(matrix)):
                    into[names[a], names[b]] = into.get((names[a], names[b]), 0) + int(matrix[a, b])
                matrix[:] = 0
            seen = lang
            if at is not None:
                held, cells = _word_cells(code[at:end], p[at:end], count[at:end], bits[at:end].copy())
                matrix[np.ix_(held, held)] += cells
    rows = [(lang, a, b, value) for lang, pairs in sums.items() for (a, b), value in pairs.items() if a != b]
    yield pa.record_batch(
        [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))],
        ["lang", "source", "item", "value"],
    )


def pair_divergence(bitmaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) for every two sources of a language; item is the other source."""
    words = bitmaps.groupBy("lang", "word").agg(F.bit_or("bits").alias("bits"))
    absent = words.join(sizes.select("lang", "source"), "lang").select(
        "lang", "word", "source", F.lit(0).cast("bigint").alias("count"), "bits"
    )
    levels = (
        bitmaps.unionByName(absent)
        .join(sizes, ["lang", "source"])
        .select(
            "lang",
            "word",
            "source",
            "count",
            probability(F.col("count"), F.col("size"), F.col("n_terms")).alias("p"),
            "bits",
        )
    )
    sums = (
        levels.repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    )
    # Pairs that agree in everything have no cell that counts.
    every = sizes.select("lang", "source").join(sizes.select("lang", F.col("source").alias("item")), "lang")
    none = every.filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (
        sums.unionByName(none)
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(order))
    )


def audited(documents: DataFrame, min_documents: int = 3, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources (``pair``), and the terms of
    which a source has most above its language (``term``)."""
    counts = stored(term_counts(documents, min_documents), "term-counts")
    sizes = stored(group_sizes(counts), "group-sizes")
    bitmaps = stored(count_bitmaps(counts), "count-bitmaps")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_divergence(bitmaps, sizes).withColumn("part", F.lit("pair"))
    terms = leading_terms(counts, sizes, top_terms).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(terms.select(*columns))

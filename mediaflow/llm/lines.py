"""Line dedup over sorted hashes, with DataFrame functions only.

Every line long enough to count becomes a row (hash of its key, document, position); no line's text leaves its task.
The rows are range-partitioned by hash and sorted within a hash by document, the last one first. One pass along that
order meets the document that keeps a line first and its rivals after it; only the first documents of a hash go on.
A line that a document repeats shares one verdict; positions come back in where the bits are set. What is returned is
not text but bitmaps: for each text that loses lines, words of 64 lines with a bit for each line that stays. Words in
which every line stays are left out.

A hash may be a third of all lines. It is cut by document into ``PIECES``, and the piece is part of the sort key, so its
rows spread over tasks; each piece sends at most ``min_documents`` documents to the hash's verdict, and the verdict
goes back to the pieces, not to the hash. Keys are told apart by 128 bits.

Defined cases: NULL or empty text is one empty line. A document is an id: rows that share one count once, and all of
them keep the lines which that id keeps. Rows without an id count as one document that sorts before all others. Equal
rows get equal results, each its own. A line that one document repeats goes or stays there as a whole. Very long texts
are one row with one bitmap; their lines spread like all others. An empty table gives empty results. Other columns stay,
and one named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import stored

PIECES = 256
WORD = 64
# The white space and the capitals of the contract.
SPACES = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, capitals A-Z small."""
    bare = F.btrim(line, F.lit(SPACES))
    # Where every character is one byte, lower() does the same and is many times faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, CAPITALS, SMALL)
    )


def digests(value: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits that do not depend on one another."""
    return F.xxhash64(value), F.xxhash64(F.lit(20240), value)


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    first, second = digests(F.coalesce(F.col(text_col), F.lit("")))
    return documents.select(
        F.col(id_col).alias("id"), first.alias("t1"), second.alias("t2"), F.col(text_col).alias("text")
    )


def line_rows(documents: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, piece, id, t1, t2, pos) for each line whose key has at least ``min_chars`` code points."""
    lines = _texts(documents, id_col, text_col).select(
        "id", "t1", "t2", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    first, second = digests(F.col("key"))
    # Rows without an id would all fall into one piece; their text deals them out.
    owner = F.when(F.col("id").isNull(), F.xxhash64("t1", "t2")).otherwise(F.xxhash64("id"))
    return keyed.select(
        first.alias("h1"),
        second.alias("h2"),
        F.pmod(owner, F.lit(PIECES)).cast("int").alias("piece"),
        "id",
        "t1",
        "t2",
        "pos",
    )


def verdicts(rows: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, piece, keeper) for every piece of a key that ``min_documents`` documents hold; the keeper may be NULL."""
    key, piece = ["h1", "h2"], ["h1", "h2", "piece"]
    order = Window.partitionBy(*piece).orderBy(F.col("id").desc_nulls_last())
    # The first documents of a piece; Spark drops later ones before it ranks them.
    first = (
        rows.repartitionByRange(*piece)
        .withColumn("nth", F.dense_rank().over(order))
        .filter(F.col("nth") <= min_documents)
    )
    heads = first.groupBy(*piece).agg(
        F.max("id").alias("first_id"),
        F.max(F.when(F.col("id").isNotNull(), F.col("nth")).otherwise(0)).alias("named"),
        F.max(F.col("id").isNull().cast("int")).alias("unnamed"),
    )
    heads = stored(heads, "line-heads")
    keepers = (
        heads.groupBy(*key)
        .agg(F.max("first_id").alias("keeper"), (F.sum("named") + F.max("unnamed")).alias("documents"))
        .filter(F.col("documents") >= min_documents)
    )
    return heads.select(*piece).join(keepers.drop("documents"), key)


def keep_bitmaps(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_documents: int = 3
) -> DataFrame:
    """(id, t1, t2, n_dropped, keep) for each text that loses a line.

    t1 and t2 are the text's hashes. ``keep`` lists (word, bits) by word: bit i of word w says whether line 64 w + i
    stays. A line whose key is found in ``min_documents`` documents stays in the one with the largest id only.
    """
    rows = stored(line_rows(documents, id_col, text_col, min_chars), "lines")
    of_piece = verdicts(rows, min_documents)
    gone = rows.join(of_piece, ["h1", "h2", "piece"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % WORD).cast("int"))
    words = gone.groupBy("id", "t1", "t2", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("drop")
    )
    return words.groupBy("id", "t1", "t2").agg(
        F.sum(F.bit_count("drop")).cast("bigint").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits")))).alias("keep"),
    )


def unpacked(keep: Column) -> Column:
    """All words up to the last that is listed, those left out filled in."""

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
        gap = F.array_repeat(F.lit(-1).cast("bigint"), entry["word"] - before - 1)
        return F.concat(gap, F.array(entry["bits"]))

    return F.flatten(F.transform(keep, with_gap))


def without_lines(
    documents: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with n_lines (before), n_dropped and kept: the lines that stay, joined again."""
    results = ("n_lines", "n_dropped", "kept")
    masks = bitmaps.select("id", "t1", "t2", F.col("n_dropped").alias("lost"), unpacked(F.col("keep")).alias("words"))
    columns = [name for name in documents.columns if name not in results]
    first, second = digests(F.coalesce(F.col(f"d.{text_col}"), F.lit("")))
    same = (
        F.col(f"d.{id_col}").eqNullSafe(F.col("m.id")) & (first == F.col("m.t1")) & (second == F.col("m.t2"))
    )
    joined = documents.select(*columns).alias("d").join(masks.alias("m"), same, "left")
    lines = split_lines(F.col(f"d.{text_col}"))

    def stays(line: Column, i: Column) -> Column:
        word = F.get(F.col("m.words"), F.floor(i / WORD).cast("int"))
        return F.coalesce(F.call_function("getbit", word, (i % WORD).cast("int")) == 1, F.lit(True))

    kept = F.when(F.col("m.words").isNull(), F.coalesce(F.col(f"d.{text_col}"), F.lit(""))).otherwise(
        F.array_join(F.filter(lines, stays), "\n")
    )
    return joined.select(
        *[F.col(f"d.{name}") for name in columns],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("m.lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        kept.alias("kept"),
    )

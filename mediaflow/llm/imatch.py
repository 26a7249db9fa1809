"""Document fingerprints by I-Match over many small random lexicon subsets, with DataFrame functions only.

The terms of a document are its distinct runs of letters and digits, small letters. Those within the band of inverse
document frequency are kept: at most ``common`` of all distinct texts have them (or just one has) and, if ``rare`` is
set, at least that share. Copies of a text count once, so a large group of copies keeps its own terms. Plain I-Match hashes all of them and changes with any one; so the lexicon is cut at random: by a hash of the
term, level l keeps 1 in 2**l terms, and each level is dealt into ``SUBSETS`` disjoint subsets. A document takes the
level at which it has about one term a subset, and the next; for every subset its sorted terms are hashed. The
fingerprint is the level and the hashes of both levels. Two fingerprints are compared at a level that both have:
their likeness is the share of subsets with equal hashes among those that are not empty in both.

Where none of a text's terms is in the band, all its terms are dealt out instead; where the level leaves none, or
there is none, one hash of all terms or of the text is the fingerprint. So texts of common words only, and small tables,
are told apart too.

Terms outside the band are few by count: terms that more than ``common`` of the texts have number less than the
mean of distinct terms per text over ``common`` (about 5000 for 500 terms and 10 percent), so they are sent with
the plan. With ``rare``, the same bound holds for the terms kept. The terms to be counted again are more by the number
of rows over that of distinct texts at most.

Defined cases: NULL text is empty; the empty text has the empty fingerprint; equal fingerprints have likeness 1, an
empty one and another 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.llm.common import stored

SUBSETS = 32
COMMON = 0.1


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(pieces, lambda piece: piece != ""))


def band(documents: DataFrame, text_col: str, common: float = COMMON, rare: float | None = None):
    """A predicate on terms: whether a term lies in the band, by the frequencies among distinct texts.

    Terms are counted over all rows first. Only those that this leaves in doubt are counted again, once for each
    distinct text: a row sends no more than its text's hash and those terms.
    """
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = texts.select(F.xxhash64("text")).distinct().count()
    most = max(common * total, 1)
    sizes = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    open_terms = sizes.filter(F.col("n") > most if rare is None else F.col("n") >= rare * total).select("term")
    asked = [row["term"] for row in open_terms.collect()]
    counted = (
        texts.select(
            F.xxhash64("text").alias("h"),
            F.array_join(F.filter(terms(F.col("text")), lambda term: term.isin(asked)), " ").alias("found"),
        )
        .filter("found <> ''")
        .distinct()
        .select(F.explode(F.split("found", " ")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    bounds = F.col("n") > most if rare is None else (F.col("n") <= most) & (F.col("n") >= rare * total)
    chosen = counted.filter(bounds).select("term")
    listed = [row["term"] for row in chosen.collect()] if asked else []
    if rare is None:
        return lambda term: ~term.isin(listed) if listed else F.lit(True)
    return lambda term: term.isin(listed) if listed else F.lit(False)


def _hash(term: Column) -> Column:
    return F.xxhash64(F.lit("lexicon"), term)


def fingerprint(text: Column, in_band) -> Column:
    """struct(level, low, high): the hashes of the document's level and of the next, each after its subset's number;
    empty subsets are left out."""
    found = terms(text)
    # One term a subset on average: the level follows from the number of terms.
    level = F.greatest(F.ceil(F.log2(F.greatest(F.size(found), F.lit(1)) / SUBSETS)), F.lit(0)).cast("int")

    def kept(all_terms: Column, at: Column, also=lambda term: F.lit(True)) -> Column:
        return F.filter(
            all_terms,
            lambda term: (F.pmod(_hash(term), F.pow(F.lit(2.0), at).cast("bigint")) == 0) & also(term),
        )

    def hashes(chosen: Column, at: Column) -> Column:
        own = F.filter(chosen, lambda term: F.pmod(_hash(term), F.pow(F.lit(2.0), at).cast("bigint")) == 0)
        dealt = F.array_sort(
            F.transform(
                own,
                lambda term: F.struct(
                    F.pmod(F.shiftright(_hash(term), 32), F.lit(SUBSETS)).alias("subset"), term.alias("term")
                ),
            )
        )

        def by_subset(d: Column) -> Column:
            heads = F.filter(
                F.sequence(F.lit(0), F.greatest(F.size(d) - 1, F.lit(0))),
                lambda i: (i < F.size(d)) & ((i == 0) | (F.get(d, i - 1)["subset"] != F.get(d, i)["subset"])),
            )

            def hashed(places: Column) -> Column:
                def one(head: Column, nth: Column) -> Column:
                    run = F.slice(d, head + 1, F.coalesce(F.get(places, nth + 1), F.size(d)) - head)
                    words = F.array_join(F.transform(run, lambda r: r["term"]), " ")
                    name = F.lpad(F.get(d, head)["subset"].cast("string"), 2, "0")
                    return F.concat(name, F.substring(F.sha1(words), 1, 6))

                return F.transform(places, one)

            return _once(heads, hashed)

        return _once(dealt, by_subset)

    def whole(d: Column) -> Column:
        """One hash of all terms, or of a text without any; nothing for the empty text."""
        all_of_it = F.when(F.size(d["terms"]) > 0, F.array_join(F.array_sort(d["terms"]), " ")).otherwise(d["text"])
        one = F.array(F.concat(F.lit("00"), F.substring(F.sha1(all_of_it), 1, 16)))
        return F.when(d["text"] == "", F.slice(one, 1, 0)).otherwise(one)

    def at_level(d: Column) -> Column:
        def hashed(chosen: Column, at: Column) -> Column:
            return F.when(F.size(chosen) > 0, hashes(chosen, at)).otherwise(whole(d))

        return _once(
            _once(
                kept(d["terms"], d["level"], in_band),
                lambda banded: F.when(F.size(banded) > 0, banded).otherwise(kept(d["terms"], d["level"])),
            ),
            lambda chosen: F.struct(
                d["level"].alias("level"),
                hashed(chosen, d["level"]).alias("low"),
                hashed(chosen, d["level"] + 1).alias("high"),
            ),
        )

    start = F.struct(found.alias("terms"), level.alias("level"), F.coalesce(text, F.lit("")).alias("text"))
    return _once(start, at_level)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value bound to a lambda variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def as_text(print_: Column) -> Column:
    """The fingerprint as a string; '' for the empty text."""
    empty = (F.size(print_["low"]) == 0) & (F.size(print_["high"]) == 0)
    return F.when(empty, F.lit("")).otherwise(
        F.concat_ws(":", print_["level"].cast("string"), F.array_join(print_["low"], ","), F.array_join(print_["high"], ","))
    )


def likeness(one: Column, other: Column) -> Column:
    """0 to 1 for two fingerprint structs."""
    level = F.greatest(one["level"], other["level"])

    def at(print_: Column) -> Column:
        return F.when(print_["level"] == level, print_["low"]).when(print_["level"] + 1 == level, print_["high"])

    def subsets(print_: Column) -> Column:
        return F.transform(at(print_), lambda entry: F.substring(entry, 1, 2))

    seen = F.size(F.array_union(subsets(one), subsets(other)))
    same = F.size(F.array_intersect(at(one), at(other)))
    return (
        F.when(as_text(one) == as_text(other), F.lit(1.0))
        .when(at(one).isNull() | at(other).isNull() | (seen == 0), F.lit(0.0))
        .otherwise(same / seen)
    )


def sequence_of(documents: DataFrame) -> DataFrame:
    """(key, h, n, doc_id, next_key, next_h): each document's successor by (key, h), the last one's being the first.

    A range sort deals the documents to partitions in order; within them the successor is the next row, at
    their ends it is the first of the next partition, of which there is a row per partition.
    """
    rows = documents.select("key", "h", "n", "doc_id").distinct()
    ranged = rows.repartitionByRange("key", "h").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "order")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("key", "h")).alias("first"))
    by_part = Window.orderBy("part")
    after = firsts.select(
        "part",
        F.coalesce(
            F.lead("first").over(by_part),
            F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        ).alias("after"),
    )
    in_part = Window.partitionBy("part").orderBy("key", "h")
    return (
        ranged.withColumn("next", F.lead(F.struct("key", "h")).over(in_part))
        .join(F.broadcast(after), "part")
        .withColumn("next", F.coalesce("next", "after"))
        .select("key", "h", "n", "doc_id", F.col("next.key").alias("next_key"), F.col("next.h").alias("next_h"))
    )


def edited_pairs(documents: DataFrame, id_col: str, text_col: str, in_band) -> DataFrame:
    """(doc_id, n, edited, print, edited_print, next_print): fingerprints of each document, of its edited text and of
    the document after it.

    Edited: the last quarter of the code points replaced by as many first ones of the next document. Rows equal in
    id and text are one document; rows with one id go by a hash of the text. NULL ids come first. Texts are shuffled
    once; the document before gets no more than the characters it borrows and the fingerprint.
    """
    keyed = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumns(
        {
            "key": F.coalesce("doc_id", F.lit(-(2**63))),
            "h": F.xxhash64("doc_id", "text"),
            "n": F.char_length("text").cast("bigint"),
        }
    )
    order = sequence_of(keyed)
    quarter = F.floor(F.col("n") / 4).cast("int")
    once = Window.partitionBy("key", "h").orderBy("key", "h")
    # Both uses below read these three columns and no others, so that they share one exchange of the texts.
    whole = (
        keyed.select("key", "h", "text").withColumn("copy", F.row_number().over(once)).filter("copy = 1").drop("copy")
    )
    lenders = order.select(
        F.col("key").alias("to_key"),
        F.col("h").alias("to_h"),
        "doc_id",
        "n",
        quarter.alias("quarter"),
        F.col("next_key").alias("key"),
        F.col("next_h").alias("h"),
    )
    lent = whole.join(lenders, ["key", "h"]).select(
        F.col("to_key").alias("key"),
        F.col("to_h").alias("h"),
        "doc_id",
        "n",
        F.left("text", F.col("quarter")).alias("borrowed"),
        fingerprint(F.col("text"), in_band).alias("next_print"),
    )
    edited = whole.join(lent, ["key", "h"]).withColumn(
        "edited", F.concat(F.left("text", F.col("n").cast("int") - quarter), F.col("borrowed"))
    )
    return edited.select(
        "doc_id",
        "n",
        "edited",
        fingerprint(F.col("text"), in_band).alias("print"),
        fingerprint(F.col("edited"), in_band).alias("edited_print"),
        "next_print",
    )

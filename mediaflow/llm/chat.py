"""Chat formatting: turns of a conversation to one training string, by Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same role are merged
under one header; parts are joined to

    ### <role>: <text></turn><text of the next turn of the same role></turn>### <role>: ...

Inside texts and roles ``\\`` becomes ``\\\\``, ``##`` becomes ``\\h#``, ``</turn>`` becomes ``\\l/turn>``
and, in roles, ``:`` becomes ``\\c``. So ``###`` only starts a header, ``</turn>`` only ends a turn, and
``parsed`` gives back every turn as it was.

Defined cases: a NULL text or role counts as empty. Turns sort by turn (NULL first), role, text, so ties and
repeated rows have one order, and repeated rows stay. A NULL conversation id is a conversation of its own.
Other columns are ignored. Lengths are code points. One conversation is one output string, so it must fit a
row; nothing else is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, COLON, END = "### ", ": ", "</turn>"


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("\\h#"))
    text = F.replace(text, F.lit(END), F.lit("\\l/turn>"))
    return F.replace(text, F.lit(":"), F.lit("\\c")) if role else text


def unescaped(text: Column) -> Column:
    """Pairs of backslashes are cut out first, so what stands between them holds no escaped backslash."""
    pieces = F.split(text, r"\\\\", -1)

    def plain(piece: Column) -> Column:
        for mark, sign in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            piece = F.replace(piece, F.lit(mark), F.lit(sign))
        return piece

    return F.array_join(F.transform(pieces, plain), "\\")


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask, loss_spans) per conversation of (conv_id, turn, role, text).

    ``loss_mask`` has one boolean per turn in output order; ``loss_spans`` gives the same as (start, chars)
    in code points of ``formatted``, without the end marks.
    """
    collected = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn",
                    F.coalesce(F.col("role"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    # A header stands where the role changes; turns of one role share it.
    heads = F.transform(
        F.col("turns"),
        lambda t, i: F.when(
            (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"]),
            F.concat(F.lit(HEADER), escaped(t["role"], role=True), F.lit(COLON)),
        ).otherwise(""),
    )
    bodies = F.transform(F.col("turns"), lambda t: escaped(t["text"]))
    parts = F.arrays_zip(F.col("heads"), F.col("bodies"))
    written = collected.withColumn("heads", heads).withColumn("bodies", bodies)
    lengths = F.transform(
        parts,
        lambda p: F.struct(
            F.char_length(p["heads"]).cast("bigint").alias("head"),
            F.char_length(p["bodies"]).cast("bigint").alias("body"),
        ),
    )
    # Where each text starts: sums of what stands before it.
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, n: F.struct(
            (acc["at"] + n["head"] + n["body"] + len(END)).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + n["head"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    spans = F.transform(
        F.filter(
            F.arrays_zip(starts.alias("start"), F.col("bodies"), F.col("turns")),
            lambda p: p["turns"]["role"] == loss_role,
        ),
        lambda p: F.struct(p["start"].alias("start"), F.char_length(p["bodies"]).cast("bigint").alias("chars")),
    )
    return written.select(
        "conv_id",
        F.array_join(
            F.transform(parts, lambda p: F.concat(p["heads"], p["bodies"], F.lit(END))), ""
        ).alias("formatted"),
        F.transform("turns", lambda t: t["role"] == loss_role).alias("loss_mask"),
        spans.alias("loss_spans"),
    )


def parsed(formatted_text: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>, exactly as they went in."""
    # The headers cut the string in runs of one role; each ended text of a run is one turn.
    cut = F.split(formatted_text, HEADER, -1)
    runs = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))

    def turns_of(run: Column) -> Column:
        role = F.substring_index(run, COLON, 1)
        rest = F.substring(run, F.char_length(role) + len(COLON) + 1, F.lit(2**31 - 1))
        texts = F.split(rest, END, -1)
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1),
            lambda text: F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")),
        )

    return F.flatten(F.transform(runs, turns_of))

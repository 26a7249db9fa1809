"""A Bloom filter of a key column, applied in the scan of the other side before that is shuffled.

The filter is a table: words of 64 bits in blocks of ``BLOCK_WORDS``, one row a block. A key has one word and up to
``BITS`` bits in it. Rows whose word lacks one of their bits cannot have a partner; a broadcast semi-join drops them
where they are read. What is broadcast is as large as the caller's limit at most, whatever the number of keys: with
more keys a key gets fewer bits, and where these would be too few to tell keys apart there is no filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
BLOCK_WORDS = 512
BITS = 4
# With ten bits a key about one foreign key in forty passes, with four one in five.
BITS_PER_KEY = 10
LEAST_BITS_PER_KEY = 4
BLOCK_BYTES = BLOCK_WORDS * 8 + 128
SEED = 77

# Types whose equal values always have equal hashes.
HASHED_ALIKE = (T.StringType, T.BinaryType, T.IntegralType, T.DateType, T.TimestampType, T.BooleanType)

BLOCK, WORDS = "__block", "__words"


def hashes_alike(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether equal keys of the two sides have one hash: same type, and one without two forms of a value."""
    kind = left.schema[key].dataType
    return kind == right.schema[key].dataType and isinstance(kind, HASHED_ALIKE)


def _word(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks * BLOCK_WORDS))


def _mask(key: Column) -> Column:
    draw, mask = F.xxhash64(F.lit(SEED), key), F.lit(0).cast("bigint")
    for i in range(BITS):
        at = F.shiftright(draw, 6 * i).bitwiseAND(WORD - 1).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def blocks_for(n_keys: int, limit_bytes: int) -> int | None:
    """Blocks of a filter for so many keys; None where the limit leaves too few bits for each."""
    wanted = max(1, math.ceil(n_keys * BITS_PER_KEY / (WORD * BLOCK_WORDS)))
    blocks = min(wanted, limit_bytes // BLOCK_BYTES)
    if blocks * WORD * BLOCK_WORDS < n_keys * LEAST_BITS_PER_KEY:
        return None
    return blocks or None


def filter_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words): the bits of all keys. Blocks that no key falls into are missing."""
    column = F.col(f"`{key}`")
    # Bits are joined before the shuffle, so a task sends each word once, however often a key is repeated.
    words = (
        keys.filter(column.isNotNull())
        .groupBy(_word(column, blocks).alias("word"))
        .agg(F.bit_or(_mask(column)).alias("bits"))
    )
    at = (F.col("word") % BLOCK_WORDS).cast("int").alias("at")
    listed = words.groupBy(F.floor(F.col("word") / BLOCK_WORDS).alias(BLOCK)).agg(
        F.array_sort(F.collect_list(F.struct(at, "bits"))).alias("listed")
    )
    zero = F.lit(0).cast("bigint")
    entries = F.col("listed")

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get(entries, i - 1)["at"], F.lit(-1))
        return F.concat(F.array_repeat(zero, entry["at"] - before - 1), F.array(entry["bits"]))

    return listed.select(BLOCK, F.flatten(F.transform(entries, with_gap)).alias(WORDS))


def prefilter(df: DataFrame, keys: DataFrame, key: str, limit_bytes: int) -> DataFrame:
    """Rows whose key may be among ``keys``: all that are, and few others. Rows with a NULL key go.

    ``df`` itself comes back where no filter fits or the two key types do not hash alike.
    """
    if not hashes_alike(df, keys, key):
        return df
    blocks = blocks_for(keys.count(), limit_bytes)
    if blocks is None:
        return df
    column = F.col(f"`{key}`")
    word, mask = _word(column, blocks), _mask(column)
    bits = F.get(F.col(WORDS), (word % BLOCK_WORDS).cast("int"))
    holds = (F.floor(word / BLOCK_WORDS) == F.col(BLOCK)) & (bits.bitwiseAND(mask) == mask)
    return df.join(F.broadcast(filter_table(keys, key, blocks)), holds, "left_semi")

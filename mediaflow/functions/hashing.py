"""Draws that depend on a key and a seed only, the same on every run, layout and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(key: Column, seed: int | str) -> Column:
    """Hex digest of ``key:seed``; its order is a random but repeatable one."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def drawn_below(digest: Column, share: float) -> Column:
    """Whether the number in the first 32 bits of the digest lies below ``share``.

    Digests are lower-case hexadecimal, so comparing them as text with the bound's eight digits is
    comparing numbers, without taking the digest apart.
    """
    bound = math.ceil(share * 2**32)
    return F.lit(True) if bound >= 2**32 else digest < F.lit(f"{bound:08x}")


def seeded_uniform(key: Column, seed: int | str, word: int = 0) -> Column:
    """Number in [0, 1) from one of the four 32-bit words of the digest."""
    digits = F.substring(seeded_digest(key, seed), 8 * word + 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**32))

"""Counter-based randomness: a draw is a function of its key alone, so it depends on no partitioning and survives retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in key)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def normal(*key: Column) -> Column:
    """A standard normal by Box and Muller's transform of two uniforms."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(*key, F.lit("a")))) * F.cos(2.0 * math.pi * uniform(*key, F.lit("b")))


def unit_seed(handle: Column) -> Column:
    """31-bit seed of a unit's name, mixed with a fixed constant."""
    return F.crc32(handle.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseXOR(F.lit(0x5EED))

"""Repeatable random numbers from hashes: the same for a row on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1), one of 2^52."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**52 - 2)) + 1) / F.lit(float(2**52))


def normal(seed: int, *parts: Column) -> Column:
    u, v = uniform(seed, F.lit("u"), *parts), uniform(seed, F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)

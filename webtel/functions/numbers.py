"""Small numeric functions as columns."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_power_of_two(c: Column) -> Column:
    """The least power of two that is not smaller; 0 for numbers below 1."""
    bits = F.length(F.bin(c.cast("long") - 1))
    return F.when(c < 1, F.lit(0)).when(c == 1, F.lit(1)).otherwise(F.pow(F.lit(2), bits)).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def pairwise_coprime(values: list[int]) -> bool:
    """Whether no two of a configuration's few numbers have a common divisor."""
    return all(math.gcd(a, b) == 1 for a, b in combinations(values, 2))


def _unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of a key, the same in each run."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10)
    return word.cast("double") / float(1 << 52)


def uniform_int(key: Column, low: int, high: int, seed: int = 0) -> Column:
    """An integer from `low` to `high`, both included, without bias beyond 2**-52."""
    return (F.lit(low) + F.floor(_unit(key, seed) * (high - low + 1))).cast("long")


def uniform_float(key: Column, low: float, high: float, seed: int = 0) -> Column:
    return F.lit(low) + _unit(key, seed) * (high - low)


def jittered(key: Column, period: float, share: float = 0.1, seed: int = 0) -> Column:
    """A period that is longer or shorter by up to a share of it, for each key."""
    return uniform_float(key, period * (1 - share), period * (1 + share), seed)


def first_end(key: Column, now: Column, period: int, seed: int = 0) -> Column:
    """When the first period of a key ends: at a random place within one period from now."""
    return now + uniform_int(key, 0, period, seed)

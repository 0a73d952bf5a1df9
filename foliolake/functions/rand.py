"""Seeded draws as pure column expressions.

A draw is a hash of its key, so it does not depend on row order, partitioning or retries: the same
key gives the same value on any executor, and no serial section is needed to plan in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolake.constants import MICRO


def keyed_text(*parts) -> Column:
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def keyed_digest(*parts) -> Column:
    return F.sha2(keyed_text(*parts), 256)


def unit_uniform(*parts) -> Column:
    """Uniform in [0, 1) from 52 hash bits, exact in a double."""
    return F.conv(F.substring(keyed_digest(*parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def hash_u64(*parts) -> Column:
    """The first 8 hash bytes as an unsigned 64-bit value (decimal(20,0))."""
    return F.conv(F.substring(keyed_digest(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fraction(*parts) -> Column:
    """The first 8 hash bytes as a fraction of 2**64."""
    return hash_u64(*parts).cast("double") / F.lit(float(2**64))


def seed63(*parts) -> Column:
    """A 63-bit seed: the top 63 of the first 64 hash bits."""
    return F.floor(hash_u64(*parts) / F.lit(2).cast("decimal(1,0)")).cast("bigint")


def int_between(low, high, *parts) -> Column:
    """Inclusive integer range."""
    lo = low if isinstance(low, Column) else F.lit(int(low))
    hi = high if isinstance(high, Column) else F.lit(int(high))
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    return (lo + F.floor(unit_uniform(*parts) * (hi - lo + 1))).cast("bigint")


def micro_between(low, high, *parts) -> Column:
    """Inclusive range on the 1e-6 grid, as integer micro-units."""
    lo = low if isinstance(low, Column) else F.lit(round(low * MICRO))
    hi = high if isinstance(high, Column) else F.lit(round(high * MICRO))
    return int_between(lo, hi, *parts)


def float_between(low, high, *parts) -> Column:
    """Inclusive float range rounded to 6 decimals."""
    return micro_between(low, high, *parts) / F.lit(float(MICRO))


def sample_seed(seed, epoch, index) -> Column:
    """Seed of one (seed, epoch, index) draw."""
    return seed63(seed, epoch, index)


def pick(options: Column, *parts) -> Column:
    """One element of an array, drawn with replacement; NULL from an empty array."""
    return F.get(options, F.floor(unit_uniform(*parts) * F.size(options)).cast("int"))

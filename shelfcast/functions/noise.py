"""Seeded noise: pure functions of (seed, salt, row keys).

No ``rand()``: values depend on neither partitioning nor task order, so a lost task
recomputes to the same rows. Keys are hashed with their own type (a DATE as a date).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def noise_int(seed: int, salt: str, *keys: str, modulo: int, offset: int = 0) -> Column:
    """Integer in [offset, offset + modulo)."""
    bucket = F.pmod(F.hash(F.lit(str(seed)), F.lit(salt), *keys), F.lit(modulo))
    return bucket + offset if offset else bucket


def noise_fraction(seed: int, salt: str, *keys: str, buckets: int = 10000) -> Column:
    """Double in [0, 1) on a grid of ``buckets`` steps."""
    return noise_int(seed, salt, *keys, modulo=buckets).cast("double") / F.lit(float(buckets))

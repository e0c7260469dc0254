"""Reproducible pseudo-random numbers from row keys.

MD5 gives the same numbers in every engine and on every recompute, so samples
and splits survive lost executors and can be checked elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationcare.settings import SEED

HASH_SPAN = float(1 << 60)


def stable_hash(*keys: Column, seed: int | str = SEED) -> Column:
    """Whole number in [0, 2**60)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stable_uniform(*keys: Column, seed: int | str = SEED) -> Column:
    """Double in [0, 1)."""
    return stable_hash(*keys, seed=seed).cast("double") / F.lit(HASH_SPAN)

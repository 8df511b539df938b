"""Reproducible randomness: uniforms from a hash of seed and id, the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *ids: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id[:id..])."""
    text = F.concat_ws(":", F.lit(seed), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def order_key(seed: str, *ids: Column) -> Column:
    """A shuffled order: sort by this."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[i.cast("string") for i in ids]))

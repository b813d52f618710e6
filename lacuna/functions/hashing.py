"""Repeatable pseudo-random draws.

``rand(seed)`` depends on how rows are partitioned, so a retried or
re-partitioned stage would draw differently. These draws depend only on the
row's own key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def draw(keys: Sequence[Column], seed: str | None = None) -> Column:
    """A 32-bit unsigned integer from the key columns, as LONG."""
    parts = [F.lit(seed)] if seed is not None else []
    parts += [k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(keys: Sequence[Column], seed: str | None = None) -> Column:
    """A double in [0, 1)."""
    return draw(keys, seed).cast("double") / F.lit(float(DRAW_RANGE))

"""Column builders over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_count(n: Column) -> Column:
    """Unordered pairs among n things (long)."""
    return F.floor(n * (n - 1) / 2).cast("long")


def ratio(hits: Column, of: Column) -> Column:
    """hits / of; 1 where there is nothing to hit."""
    return F.when(of == 0, 1.0).otherwise(hits / F.when(of == 0, 1).otherwise(of))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval of a share, within 0 and 1; 0 and 0 for no trials."""
    trials = F.when(n == 0, 1).otherwise(n).cast("double")
    p = hits / trials
    scale = 1 + z * z / trials
    middle = (p + z * z / (2 * trials)) / scale
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / scale
    return F.when(n == 0, 0.0).otherwise(F.greatest(middle - half, F.lit(0.0))), F.when(n == 0, 0.0).otherwise(F.least(middle + half, F.lit(1.0)))

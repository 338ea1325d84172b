"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length, in double; a zero vector is unchanged."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def l2_score(squared_distance: Column) -> Column:
    """Larger is better: 1 / (1 + squared distance)."""
    return F.lit(1.0) / (F.lit(1.0) + squared_distance)

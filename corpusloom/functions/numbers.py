"""Rounding as SQL engines do it on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int = 0) -> Column:
    """``x`` to so many places, halves away from zero, decided on the double ``x * 10 ** places``; null stays null.

    Spark's own ``round`` decides on the shortest decimal that names the double: where a sum ends a
    last bit beside a half, it gives another neighbour. A negative number that rounds to nothing is
    -0.0, one too large to be scaled stays as it is. ``x`` is worked out once.
    """
    scale = float(10**places)
    near = lambda v: F.round(v * scale, 0) / scale
    return F.transform(F.array(x), lambda v: F.when(F.abs(v * scale) == float("inf"), v).when(v < 0, -near(-v)).otherwise(near(v)))[0]

"""Keys that hold a large share of a table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy that holds this share of all rows, one in so many; so there are no more heavy keys than that.
SHARE = 1000


def heavy_keys(df: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """by, n: the keys with a thousandth of all rows or more, and ``least`` rows; a thousand rows at most, fit to be sent to all tasks."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = df.count()
    return sizes.where((F.col("n") * SHARE >= total) & (F.col("n") >= least))


def lookup(left: DataFrame, right: DataFrame, key: str, other: str, whole: int = 1_000_000) -> DataFrame:
    """Inner join of ``left``.key with ``right``.other, which is unique.

    Heavy keys of more than ``whole`` rows, a thousand at most, meet their row by broadcast, so no task gets all their rows.
    """
    hot = [r[0] for r in heavy_keys(left.select(key), [key], least=whole + 1).select(key).collect()]
    if not hot:
        return left.join(right, F.col(key) == F.col(other))
    few = left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(other).isin(hot))), F.col(key) == F.col(other))
    return few.unionByName(left.where(~F.col(key).isin(hot)).join(right.where(~F.col(other).isin(hot)), F.col(key) == F.col(other)))

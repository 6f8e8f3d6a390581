"""Joins and row choices that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: dict[str, str], period: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it.

    Both sides are tagged and shuffled once by ``keys``; a running last value
    replaces a range join. ``take`` maps right columns to names. Right rows should
    be unique by keys and time.

    ``period`` (such as the day of a time, rising with it) splits the histories of keys that
    are too long for one task: each key and period is a group of its own, and the last
    value before it is carried in. What is carried has one row a key and period.
    """
    names = [c for c in left.columns if c not in (*keys, at)]
    value = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    l = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*names).alias("_left"))
    r = right.select(*keys, at, F.lit(0).alias("_side"), value.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    groups = list(keys)
    if period is not None:
        both = both.withColumn("_period", period(F.col(at)))
        groups.append("_period")
        # A right row's value is never null itself, though its fields may be.
        closing = both.groupBy(*groups).agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col(at))).alias("_right"))
        earlier = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
        carried = closing.withColumn("_right", F.last("_right", ignorenulls=True).over(earlier)).filter("_right IS NOT NULL")
        both = both.unionByName(carried.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    w = Window.partitionBy(*groups).orderBy(F.col(at).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*keys, at, "_left.*", "_found.*")


def keep_latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so map sides reduce before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*")


def range_or_null(x: Column, low: float | None, high: float | None) -> Column:
    """Within bounds; a null passes only if there are none."""
    if low is None and high is None:
        return F.lit(True)
    ok = x.isNotNull()
    if low is not None:
        ok = ok & (x >= low)
    return ok & (x <= high) if high is not None else ok


def filing_available(period_end: Column, published: Column) -> Column:
    """When a filing was known: its publication if 10 to 120 days after the period, else a lag by quarter."""
    lag = F.when(F.quarter(period_end) == 2, 55).when(F.quarter(period_end) == 4, 35).otherwise(45)
    return F.when(F.datediff(published, period_end).between(10, 120), published).otherwise(F.date_add(period_end, lag))

"""Cross-sectional statistics: all of a date, across symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Logarithmic buckets of p-values, eight for each factor of e.
BUCKETS = 5600


def rank_average(x: Column, *by: str) -> Column:
    """Rank from 1 with ties averaged; null stays null. Two windows over one partitioning."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def rank_pct(x: Column, *by: str) -> Column:
    """Average-tie rank over the number of values, times 100."""
    return rank_average(x, *by) / F.count(x).over(Window.partitionBy(*by)) * 100


def zscore(x: Column, *by: str, least: float = 1e-12) -> Column:
    """Deviations from the mean in sample standard deviations; null where there is no spread."""
    w = Window.partitionBy(*by)
    spread = F.stddev_samp(x).over(w)
    return F.when(spread > least, (x - F.avg(x).over(w)) / spread)


def winsorize(df: DataFrame, x: str, by: str, low: float, high: float, name: str) -> DataFrame:
    """Clips to exact interpolated quantiles of each group: a window, so ``df`` is read once."""
    bounds = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(Window.partitionBy(by))
    clipped = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_q")[0]), F.col("_q")[1]))
    return df.withColumn("_q", bounds).withColumn(name, clipped).drop("_q")


def quantile_bucket(df: DataFrame, x: str, by: str, n: int, name: str) -> DataFrame:
    """Right-closed buckets 0 to n - 1 between interpolated quantiles."""
    return above(df.withColumn("_q", _borders(x, n).over(Window.partitionBy(by))), x, name)


def _borders(x: str, n: int) -> Column:
    return F.percentile(x, F.array(*[F.lit(k / n) for k in range(1, n)]))


def quantiles(df: DataFrame, x: str, by: str, n: int) -> DataFrame:
    """The borders of ``quantile_bucket`` (``_q``), a row a group; rows stay where they are."""
    return df.groupBy(by).agg(_borders(x, n).alias("_q"))


def above(df: DataFrame, x: str, name: str) -> DataFrame:
    """How many of the borders ``_q`` lie below ``x``."""
    n = F.aggregate("_q", F.lit(0), lambda a, q: a + F.when(F.col(x) > q, 1).otherwise(0))
    return df.withColumn(name, F.when(F.col(x).isNotNull(), n)).drop("_q")


def benjamini_hochberg(df: DataFrame, p: str, tie: str, name: str) -> DataFrame:
    """P-values adjusted for the rate of false discoveries, without one task that sorts them all.

    Values are dealt over logarithmic buckets, of which there are at most ``BUCKETS``;
    only the buckets' counts and least candidates meet in one place.
    """
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(-F.log(F.greatest(F.col(p), F.lit(1e-300))) * 8)).cast("int")
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    # Higher buckets hold smaller values.
    up = Window.orderBy(F.desc("_bucket"))
    first = F.coalesce(F.sum("_size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_bucket", first.alias("_first"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    w = Window.partitionBy("_bucket").orderBy(p, tie)
    rows = rows.join(F.broadcast(sizes), "_bucket").withColumn("_k", F.col("_first") + F.row_number().over(w))
    rows = rows.withColumn("_a", F.col(p) * F.col("_all") / F.col("_k"))
    least = rows.groupBy("_bucket").agg(F.min("_a").alias("_least"))
    beyond = F.min("_least").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(least.select("_bucket", beyond.alias("_beyond"))), "_bucket")
    own = F.min("_a").over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(name, F.least(F.lit(1.0), own, "_beyond")).drop("_bucket", "_first", "_all", "_k", "_a", "_beyond")


def dealt_rank(df: DataFrame, x: str, by: str, name: str, ranges: int = 256) -> DataFrame:
    """``rank_average`` of ``x`` within ``by`` for groups too large for one task: values are dealt over ranges between approximate quantiles.

    Equal values lie in one range; only the ranges' sizes meet in one place. Null stays null.
    """
    cuts = df.groupBy(by).agg(F.percentile_approx(x, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 4 * ranges).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(x)))
    rows = df.join(F.broadcast(cuts), by, "left").withColumn("_range", F.when(F.col(x).isNotNull(), place)).drop("_cuts")
    sizes = rows.filter(F.col(x).isNotNull()).groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(sizes.select(by, "_range", F.coalesce(before, F.lit(0)).alias("_first"))), [by, "_range"], "left")
    w = Window.partitionBy(by, "_range")
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, "_range", x))
    rank = F.col("_first") + F.rank().over(w.orderBy(x)) + (ties - 1) / 2
    return rows.withColumn(name, F.when(F.col(x).isNotNull(), rank)).drop("_range", "_first")

"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import discard, staged

#: A key with more than 1/HOT of the rows is joined by broadcast; there are fewer than HOT such keys.
HOT, LEAST_HOT = 1024, 256


def attach(rows: DataFrame, key: str, total: int, *aggregates: Column, least: int = 1) -> DataFrame:
    """``rows`` with aggregates of their key's group, where a group has at least ``least`` rows.

    ``total`` is the number of rows. Hot keys are fewer than ``HOT``: their names go to
    the driver and their groups are broadcast, so their rows stay where they are; the
    rest meet in a shuffle. ``rows`` is read several times.
    """
    most = max(LEAST_HOT, total // HOT)
    told = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    hot = [r[0] for r in told.filter(F.col("_rows") > most).select(key).collect()]
    cold = rows.filter(~F.col(key).isin(hot)) if hot else rows
    rest = cold.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *aggregates).filter(F.col("_rows") >= least).drop("_rows")
    out = cold.join(rest, key)
    if hot:
        warm = rows.filter(F.col(key).isin(hot))
        out = out.unionByName(warm.join(F.broadcast(warm.groupBy(key).agg(*aggregates)), key))
    return out


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    at = attach(both, "u", 2 * total, F.min("v").alias("m"))
    return at.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    at = attach(down, "u", total, F.min("v").alias("m"))
    # A node's own edge to the least replaces that of the least with itself.
    return at.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (u, v: long).

    Alternating large-star and small-star steps, each written to the shared
    folder, until the edges no longer change; loops and repeats don't matter.
    """
    e = staged(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    total, before = e.count(), None
    for _ in range(rounds):
        large = staged(_large_star(e, total).filter("u <> v").distinct(), "edges")
        new = staged(_small_star(large, total).filter("u <> v").distinct(), "edges")
        discard(e, large)
        e = new
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        total, before = seen[0], seen
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

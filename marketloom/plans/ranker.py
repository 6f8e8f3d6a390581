"""A learned cross-sectional ranker: features of a bar, grades by the return after it, trees fitted on early dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import series
from marketloom.functions.ranks import above, quantiles
from marketloom.operators import ranking
from marketloom.operators.steps import written
from marketloom.plans.catalog import query
from marketloom.plans.factors import _FORGE, forged
from marketloom.plans.risk import r6, returns

FEATURES = [*_FORGE, "momentum", "reversal"]
#: The share of dates that is learned from; the date after them is left out, as its grades look beyond it.
TRAIN = 0.7


def graded(spark: SparkSession, d: str) -> DataFrame:
    """symbol, date, features, forward (the next bar's return) and grade (fifths of it within the date, 4 the best)."""
    w = series("symbol", "date")
    more = {
        "forward": F.lead("close").over(w) / F.col("close") - 1, "momentum": F.try_divide("close", F.lag("close", 6).over(w)),
        "reversal": F.col("close") / F.avg("close").over(w.rowsBetween(-11, 0)) - 1,
    }
    rows = written(forged(written(returns(spark, d)), more).filter("symbol IS NOT NULL"))
    fifths = quantiles(rows, "forward", "date", 5)
    return above(rows.join(F.broadcast(fifths), "date"), "forward", "grade").select("symbol", "date", *FEATURES, "forward", "grade")


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the dates that are learned from, and of those after the one left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    dates = rows.select("date").distinct().withColumns({"k": F.row_number().over(Window.orderBy("date")), "n": n})
    dates = dates.withColumn("part", F.when(F.col("k") <= F.col("n") * TRAIN, 0).when(F.col("k") > F.col("n") * TRAIN + 1, 1)).select("date", "part")
    told = rows.join(F.broadcast(dates), "date")
    return told.filter("part = 0").drop("part"), told.filter("part = 1").drop("part")


def learned(spark: SparkSession, d: str) -> tuple[DataFrame, list[ranking.Tree]]:
    """Scores of the later dates' symbols, and the trees."""
    early, late = parts(graded(spark, d))
    cuts = ranking.cuts_of(early, FEATURES)
    trees = ranking.fit(ranking.grouped(early, "date", "symbol", FEATURES, "grade", cuts), len(FEATURES))
    later = ranking.grouped(late, "date", "symbol", FEATURES, "grade", cuts)
    return ranking.scores(later, "date", "symbol", trees, len(FEATURES)), trees


@query("learned_ranks", dates=("date",))
def learned_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each later date's symbols by a model that has seen only earlier dates: score and rank."""
    scores, _ = learned(spark, d)
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol"))
    return scores.select("date", "symbol", r6("score").alias("score"), rank.cast("long").alias("rank"))

"""Joins of similar strings and of names within texts, without comparing all with all.

Two strings are similar if one minus their edit distance over the longer one's length is
at least a share. Within distance k they share all but k q of their q-grams (with their
number of occurrence), so in any fixed order of grams the first k q + 1 of each have one
in common. Grams are ordered from rare to frequent, so those first ones are rare; pairs
that share one, and whose lengths fit, meet by both, and are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.steps import written

Q = 2
#: Below this share a string's grams may be too few for the filter to be exact.
LOWEST = 0.7


def grams(x: Column) -> Column:
    """The q-grams of a string with a mark at both ends, each with its number among equal ones."""
    padded = F.concat(F.lit("\x02"), x, F.lit("\x03"))
    plain = F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(padded, i, F.lit(Q)))
    # Equal grams lie together when sorted; the number is the place from where they begin.
    ordered = F.array_sort(plain)
    return F.transform(ordered, lambda g, i: F.concat(g, (i - F.array_position(ordered, g).cast("int") + 1).cast("string")))


def _firsts(rows: DataFrame, text: str, least: float, counts: DataFrame) -> DataFrame:
    """The rarest grams of each string, as many as a similar one must share one of."""
    each = rows.select(text, F.explode(grams(F.col(text))).alias("gram")).join(counts, "gram")
    w = Window.partitionBy(text).orderBy("n", "gram")
    furthest = F.floor(F.length(text) * (1 - least) / least + 1e-9)
    return each.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= Q * furthest + 1).select(text, "gram")


def _fitting(lengths: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Lengths of the one side and those of the other that a similar string may have; both are distinct lengths, so few."""
    return lengths.crossJoin(others).filter(F.least("m", "n") >= F.greatest("m", "n") * least - 1e-9)


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def similar(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Distinct pairs of strings of ``left`` (column a) and ``right`` (column b) and their similarity, from ``least`` (0.7 or more) on.

    Null and empty strings are similar to nothing. Each string is compared once, however
    often it occurs.
    """
    if not LOWEST <= least <= 1:
        raise ValueError(f"the least similarity must lie between {LOWEST} and 1")
    one = written(left.select(F.col(a).alias("a")).filter("length(a) > 0").distinct())
    two = written(right.select(F.col(b).alias("b")).filter("length(b) > 0").distinct())
    # Strings meet by gram and length: those whose lengths can't fit never do, however frequent their grams are.
    lengths = _fitting(one.select(F.length("a").alias("m")).distinct(), two.select(F.length("b").alias("n")).distinct(), least)
    lengths = written(lengths)
    # A few strings make many pairs, so they are dealt over all tasks.
    tasks = 2 * one.sparkSession.sparkContext.defaultParallelism
    one = one.join(lengths.select("m").distinct(), F.length("a") == F.col("m"), "left_semi").repartition(tasks, "a")
    two = two.join(lengths.select("n").distinct(), F.length("b") == F.col("n"), "left_semi").repartition(tasks, "b")
    counts = one.select(F.explode(grams(F.col("a"))).alias("gram")).unionByName(two.select(F.explode(grams(F.col("b"))).alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts)
    firsts = _firsts(one, "a", least, counts).withColumn("m", F.length("a")).join(lengths, "m").drop("m")
    met = firsts.repartition(tasks, "gram", "n").join(_firsts(two, "b", least, counts).withColumn("n", F.length("b")), ["gram", "n"]).select("a", "b").distinct()
    told = met.withColumn("similarity", similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least - 1e-9)
    return told.select(F.col("a").alias(a), F.col("b").alias(b), "similarity")


def held(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Distinct pairs of a text and a name whose words stand in a row in it; words are parted by blanks.

    A text's runs of words, up to the longest name's number of them, meet the names as
    equal strings.
    """
    own = names.select(F.col(name).alias("name")).filter("length(name) > 0").distinct()
    most = own.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    words = texts.select(F.col(text).alias("text")).filter("length(text) > 0").distinct().withColumn("w", F.split("text", " "))
    size = F.size("w")

    def runs_of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
        return F.when(size >= n, made).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in range(1, most + 1)]
    each = words.select("text", F.explode(F.array_distinct(F.concat(*runs))).alias("name"))
    return each.join(own, "name").select(F.col("text").alias(text), F.col("name").alias(name))

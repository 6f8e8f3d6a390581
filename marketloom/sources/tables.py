"""Tables, and the market roles that the relational tables play.

``bars`` derives one bar per symbol and month from trades (``lineitem``); ``stocks``
is the dimension of symbols; ``flows`` are amounts between nations by year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, at (order of trades), price, quantity and day of every trade."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("quantity"),
    )


def bars_from_trades(t: DataFrame, *keys: str) -> DataFrame:
    """First, highest, lowest and last price, and volume, by ``keys``; one shuffle with partial aggregation."""
    return t.groupBy(*keys).agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("date", F.trunc("day", "month"))
    return bars_from_trades(t, "symbol", "date")


def bar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that bars have, from one column of the trades."""
    return load(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).distinct()


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (load(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("symbol"),
        F.col("n_name").alias("sector"),
        F.col("r_name").alias("exchange"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("market_cap"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and target nation, year and amount: one row per pair and year."""
    lines, orders, customer, supplier = (load(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    o = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    j = lines.select("l_orderkey", "l_suppkey", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(customer.select("c_custkey", F.col("c_nationkey").alias("source")), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(supplier.select("s_suppkey", F.col("s_nationkey").alias("target")), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("source", "target", "year").agg(F.sum("l_extendedprice").alias("amount"))


#: The same roles for DuckDB; queries put these before their own SQL.
SQL_BARS = """trades AS (
  SELECT l_suppkey AS symbol, l_shipdate, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day,
    l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem
), bars AS (
  SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS date,
    first(price ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(quantity) AS volume
  FROM trades GROUP BY ALL
)"""
SQL_STOCKS = """stocks AS (
  SELECT s_suppkey AS symbol, n_name AS sector, r_name AS exchange, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
SQL_FLOWS = """flows AS (
  SELECT c_nationkey AS source, s_nationkey AS target, year(o_orderdate) AS year, sum(l_extendedprice) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL
)"""

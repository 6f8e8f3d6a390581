"""Moving-average cost over executions, as windows: no state is carried by hand.

Between two moments at which a book is empty, each sale leaves the share
``1 - sold / held`` of the net cost. With P the running product of these shares,
the cost after a row is ``P * sum(cost bought / P when bought)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average_cost(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``key``, ``order``, side (BUY or SELL), shares, gross, fee and tax with quantity, cost, sold_cost and pnl.

    ``cost`` is the net cost held after the row, fees of purchases included;
    ``sold_cost`` and ``pnl`` are those of a sale, after fee and tax. From the first row
    that sells more than is held on, they are null. ``order`` must tell rows apart.
    """
    w = Window.partitionBy(key).orderBy(order)
    buys = F.col("side") == "BUY"
    signed = F.when(buys, F.col("shares")).otherwise(-F.col("shares"))
    r = rows.withColumn("quantity", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("sound", F.min("quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 0)
    # A book that was emptied begins anew with the next row.
    emptied = F.when(F.col("quantity") <= 0, 1).otherwise(0)
    r = r.withColumn("epoch", F.coalesce(F.sum(emptied).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = Window.partitionBy(key, "epoch").orderBy(order)
    held = F.col("quantity") + F.col("shares")
    left = F.when(~buys & (F.col("quantity") > 0), F.ln(F.col("quantity") / held)).otherwise(0.0)
    r = r.withColumn("log_left", F.sum(left).over(e.rowsBetween(Window.unboundedPreceding, 0)))
    bought = F.when(buys, (F.col("gross") + F.col("fee")) * F.exp(-F.col("log_left"))).otherwise(0.0)
    total = F.sum(bought).over(e.rowsBetween(Window.unboundedPreceding, 0)) * F.exp("log_left")
    r = r.withColumn("cost", F.when(F.col("sound"), F.when(F.col("quantity") > 0, total).otherwise(0.0)))
    # What was held before a sale, of which it takes its share.
    before = F.sum(bought).over(e.rowsBetween(Window.unboundedPreceding, -1)) * F.exp(F.col("log_left") - left)
    r = r.withColumn("sold_cost", F.when(F.col("sound") & ~buys, before * F.col("shares") / held))
    r = r.withColumn("pnl", F.col("gross") - F.col("fee") - F.col("tax") - F.col("sold_cost"))
    return r.drop("epoch", "log_left", "sound")


def walk_depth(levels: DataFrame, key: str, price: str, volume: str, quantity: Column | float, buy: bool = True, limit: Column | float | None = None) -> DataFrame:
    """Per book ``key`` the mean price and notional of filling ``quantity`` from the best level on; null without enough depth within the limit.

    Levels without a positive price and a whole positive volume don't count; prices
    under 500 are in thousands.
    """
    p, v = F.col(price), F.col(volume)
    scaled = F.when(p < 500, F.round(p * 1000)).otherwise(p)
    rows = levels.filter((p > 0) & (v > 0) & (v == F.floor(v))).select(key, scaled.alias("p"), v.alias("v"))
    if limit is not None:
        bound = limit if isinstance(limit, Column) else F.lit(limit)
        rows = rows.filter(F.col("p") <= bound if buy else F.col("p") >= bound)
    # Levels of one price fill alike whatever their order.
    rows = rows.groupBy(key, "p").agg(F.sum("v").alias("v"))
    w = Window.partitionBy(key).orderBy(F.col("p").asc() if buy else F.col("p").desc())
    want = quantity if isinstance(quantity, Column) else F.lit(float(quantity))
    before = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    filled = F.greatest(F.lit(0.0), F.least("v", want - before))
    done = rows.withColumn("filled", filled).groupBy(key).agg(F.sum("filled").alias("filled"), F.sum(F.col("filled") * F.col("p")).alias("notional"))
    whole = F.col("filled") == want
    return done.select(key, F.when(whole, F.col("notional") / F.col("filled")).alias("price"), F.when(whole, F.col("notional")).alias("notional"))


def call_auction(orders: DataFrame, key: str, reference: str) -> DataFrame:
    """Per ``key`` the price at which most volume of orders (side BUY or SELL, price, volume) matches.

    Of equal volumes the smallest imbalance wins, then the price nearest to
    ``reference``, then the higher one.
    """
    at = orders.groupBy(key, "price").agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("volume")).otherwise(0)).alias("bid"), F.sum(F.when(F.col("side") == "SELL", F.col("volume")).otherwise(0)).alias("ask"), F.max(reference).alias("reference"),
    )
    w = Window.partitionBy(key).orderBy("price")
    demand = F.sum("bid").over(w.rowsBetween(0, Window.unboundedFollowing))
    supply = F.sum("ask").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumns({"demand": demand, "supply": supply, "reference": F.max("reference").over(Window.partitionBy(key))})
    matched, gap = F.least("demand", "supply"), F.abs(F.col("demand") - F.col("supply"))
    best = F.struct(matched.alias("matched"), (-gap).alias("gap"), (-F.abs(F.col("price") - F.col("reference"))).alias("far"), F.col("price").alias("price"))
    out = at.filter(matched > 0).groupBy(key).agg(F.max(best).alias("b"))
    return out.select(key, F.col("b.price").alias("price"), F.col("b.matched").alias("matched"))

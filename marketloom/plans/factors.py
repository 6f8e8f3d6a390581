"""Factors of each symbol as of its last bar, their scores, and what research makes of them.

A statement is a symbol's trades of a quarter, from which the items are derived;
bars are months, so horizons are counted in bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import series
from marketloom.functions.ranks import rank_average, rank_pct
from marketloom.operators.steps import written
from marketloom.plans.catalog import query
from marketloom.plans.risk import RETURNS, r6, returns
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bars, load, stocks

ITEMS = {
    "revenue": "sum(l_extendedprice)", "income": "sum(l_extendedprice * (l_discount - 0.03))", "cash_flow": "sum(l_extendedprice * (l_tax - 0.02))", "assets": "sum(l_extendedprice) * 2 + 1000",
    "inventory": "sum(l_quantity)", "current_assets": "sum(l_extendedprice * 0.6)", "current_debt": "sum(l_extendedprice * (l_discount + 0.2))", "retained": "sum(l_extendedprice * l_tax)",
    "ebit": "sum(l_extendedprice * (l_discount - 0.02))", "equity": "sum(l_extendedprice * (0.9 + l_tax))", "gross": "sum(l_extendedprice * (1 - l_discount)) * 0.4", "interest": "sum(l_extendedprice * l_tax * 0.1)",
}
SQL_STATEMENTS = f"""statements AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, {", ".join(f"{x} AS {n}" for n, x in ITEMS.items())} FROM lineitem GROUP BY ALL),
latest AS (SELECT *, lag(income, 4) OVER w AS income4, lag(assets, 4) OVER w AS assets4, lag(revenue, 4) OVER w AS revenue4, lag(gross, 4) OVER w AS gross4, lag(current_assets / current_debt, 4) OVER w AS ratio4, lag(assets - equity, 4) OVER w AS debt4, lag(equity, 4) OVER w AS equity4
  FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY period) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period DESC) = 1)"""


def latest_statements(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's last statement, with items of the one four quarters before."""
    s = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.trunc("l_shipdate", "quarter").alias("period")).agg(*[F.expr(x).alias(n) for n, x in ITEMS.items()])
    w = Window.partitionBy("symbol").orderBy("period")
    before = {"income4": F.col("income"), "assets4": F.col("assets"), "revenue4": F.col("revenue"), "gross4": F.col("gross"), "ratio4": F.col("current_assets") / F.col("current_debt"), "debt4": F.col("assets") - F.col("equity"), "equity4": F.col("equity")}
    s = s.withColumns({n: F.lag(x, 4).over(w) for n, x in before.items()})
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period")))
    return s.withColumn("n", last).filter("n = 1").drop("n")


SQL_MARKET = """flow AS (SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'R' THEN -l_extendedprice ELSE 0 END) AS net, sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS net_shares FROM lineitem GROUP BY ALL),
x AS (SELECT ret.*, net, net_shares, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM ret JOIN flow USING (symbol, date)),
m AS (SELECT symbol, max(date) AS date, max(close) FILTER (back = 1) AS c0, max(close) FILTER (back = 2) AS c1, max(close) FILTER (back = 4) AS c3, max(close) FILTER (back = 7) AS c6, avg(abs(r) / nullif(close * volume, 0)) FILTER (back <= 20) AS amihud,
  avg(close * volume) FILTER (back <= 5) / nullif(avg(close * volume) FILTER (back <= 20), 0) - 1 AS dvol, sum(net) FILTER (back <= 5) AS net5, coalesce(min(back) FILTER (net <= 0) - 1, count(*)) AS buying, max(net_shares) FILTER (back = 1) AS insiders, 0.49 - greatest(0, sum(net_shares) / nullif(sum(volume), 0)) AS room,
  avg(CASE WHEN r >= 0.069 THEN 1.0 ELSE 0 END) FILTER (back <= 10) AS ceilings, count(*) FILTER (back <= 5 AND r <= -0.069) AS floors, avg(volume) FILTER (back <= 5) / nullif(avg(volume) FILTER (back <= 20), 0) AS surge, stddev_samp(r) FILTER (back <= 20) AS vol20, stddev_samp(r) FILTER (back <= 60) AS vol60 FROM x GROUP BY symbol)"""
#: Each factor over the columns of the last statement, the market and the symbol; text that both engines read.
FACTORS = {
    "pe_inv": "CASE WHEN income > 0 THEN 1 / nullif(market_cap / (4 * income), 0) END", "pb_inv": "CASE WHEN equity > 0 THEN equity / nullif(market_cap, 0) END", "ev_ebitda_inv": "CASE WHEN ebit > 0 THEN ebit / nullif(market_cap + assets - equity, 0) END", "de_inv": "CASE WHEN assets > equity THEN equity / nullif(assets - equity, 0) END",
    "roe": "income / nullif(equity, 0)", "gross_margin": "gross / nullif(revenue, 0)", "net_margin": "income / nullif(revenue, 0)", "growth": "revenue / nullif(revenue4, 0) - 1", "fcf_yield": "cash_flow / nullif(market_cap, 0)",
    "net_interest": "(interest - 0.3 * interest) / nullif(assets, 0)", "inventory_turnover": "revenue / nullif(inventory, 0)", "mom1": "c0 / nullif(c1, 0) - 1", "mom3": "c1 / nullif(c3, 0) - 1", "mom6": "c1 / nullif(c6, 0) - 1",
    "amihud": "amihud * 1e6", "earnings_yield": "4 * income / nullif(market_cap, 0)", "accrual": "-(income - cash_flow) / nullif(assets, 0)", "cash_to_income": "cash_flow / nullif(abs(income), 0)", "cond_mom": "(c1 / nullif(c3, 0) - 1) * (1 + 0.5 * regime)", "dvol_trend": "dvol",
    "foreign_net5": "net5 / nullif(market_cap, 0)", "foreign_streak": "buying / 10.0", "insider_net": "insiders / nullif(market_cap / c0, 0)", "size": "ln(market_cap)", "surprise": "(income - income4) / nullif(abs(income4), 0)",
    "altman": "6.56 * (current_assets - current_debt) / nullif(assets, 0) + 3.26 * retained / nullif(assets, 0) + 6.72 * ebit / nullif(assets, 0) + 1.05 * equity / nullif(assets - equity, 0)",
    "piotroski": " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in (
        "income > 0", "cash_flow > 0", "income / assets > income4 / assets4", "cash_flow > income", "(assets - equity) / assets < debt4 / assets4", "current_assets / current_debt > ratio4", "equity <= equity4 * 1.02", "gross / revenue > gross4 / revenue4", "revenue / assets > revenue4 / assets4")),
    "book_to_market": "equity / nullif(market_cap, 0)", "holiday": "CASE WHEN month(date) = 1 THEN 1.0 WHEN month(date) = 2 THEN -0.5 ELSE 0.0 END", "ceiling_streak": "ceilings", "forced_selling": "CASE WHEN floors >= 2 AND surge > 3 THEN 1.0 ELSE 0.0 END",
    "foreign_room": "CASE WHEN room < 0.05 THEN -1.0 WHEN room > 0.3 THEN 0.5 ELSE 0.0 END", "vol20": "vol20", "vol60": "vol60",
}
SQL_FACTORS = f"""{RETURNS}, {SQL_STOCKS}, {SQL_STATEMENTS}, {SQL_MARKET}, g AS (SELECT CASE WHEN avg(c0 / nullif(c3, 0) - 1) > 0 THEN 1.0 ELSE -1.0 END AS regime FROM m),
factors AS (SELECT symbol, sector, market_cap, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in FACTORS.items())} FROM m JOIN stocks USING (symbol) JOIN latest USING (symbol), g)"""


def factors(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol: all bars and trades are reduced to it before the joins."""
    flag, l = F.col("l_returnflag"), load(spark, d, "lineitem")
    side = lambda c: F.sum(F.when(flag == "A", F.col(c)).when(flag == "R", -F.col(c)).otherwise(0.0))
    flow = l.groupBy(F.col("l_suppkey").alias("symbol"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(side("l_extendedprice").alias("net"), side("l_quantity").alias("net_shares"))
    x = returns(spark, d).join(flow, ["symbol", "date"]).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    back, turnover = F.col("back"), F.col("close") * F.col("volume")
    at = lambda k, c="close": F.max(F.when(back == k, F.col(c)))
    within = lambda k, e: F.when(back <= k, e)
    m = x.groupBy("symbol").agg(
        F.max("date").alias("date"), at(1).alias("c0"), at(2).alias("c1"), at(4).alias("c3"), at(7).alias("c6"), F.avg(within(20, F.try_divide(F.abs("r"), turnover))).alias("amihud"),
        (F.try_divide(F.avg(within(5, turnover)), F.avg(within(20, turnover))) - 1).alias("dvol"), F.sum(within(5, F.col("net"))).alias("net5"), F.coalesce(F.min(F.when(F.col("net") <= 0, back)) - 1, F.count(F.lit(1))).alias("buying"), at(1, "net_shares").alias("insiders"), (0.49 - F.greatest(F.lit(0.0), F.try_divide(F.sum("net_shares"), F.sum("volume")))).alias("room"),
        F.avg(within(10, F.when(F.col("r") >= 0.069, 1.0).otherwise(0.0))).alias("ceilings"), F.count_if((back <= 5) & (F.col("r") <= -0.069)).alias("floors"), F.try_divide(F.avg(within(5, F.col("volume"))), F.avg(within(20, F.col("volume")))).alias("surge"),
        F.stddev_samp(within(20, F.col("r"))).alias("vol20"), F.stddev_samp(within(60, F.col("r"))).alias("vol60"),
    )
    g = m.agg(F.when(F.avg(F.try_divide("c0", "c3") - 1) > 0, 1.0).otherwise(-1.0).alias("regime"))
    j = m.join(stocks(spark, d), "symbol").join(latest_statements(spark, d), "symbol").crossJoin(F.broadcast(g))
    return j.select("symbol", "sector", "market_cap", *[F.expr(e).cast("double").alias(n) for n, e in FACTORS.items()])


@query("raw_factor_table", f"{SQL_FACTORS} SELECT symbol, sector, {', '.join(f'round({n}, 6) AS {n}' for n in FACTORS)} FROM factors")
def raw_factor_table(spark: SparkSession, d: str) -> DataFrame:
    return factors(spark, d).select("symbol", "sector", *[r6(n).alias(n) for n in FACTORS])


#: Groups of factors with their weights; a factor that no symbol has leaves its weight to the others.
GROUPS = {"value": {"pe_inv": 0.4, "pb_inv": 0.3, "ev_ebitda_inv": 0.3}, "quality": {"roe": 0.4, "gross_margin": 0.2, "altman": 0.2, "piotroski": 0.2}, "momentum": {"mom1": 0.3, "mom3": 0.4, "mom6": 0.3}}
_PCT = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER () * 100 END"
_USED = sorted({f for g in GROUPS.values() for f in g})
SQL_SCORES = f"""{SQL_FACTORS}, p AS (SELECT symbol, sector, ceiling_streak, {", ".join(f"{_PCT.format(x=f)} AS {f}" for f in _USED)} FROM factors),
scores AS (SELECT symbol, sector, {", ".join("(" + " + ".join(f"coalesce({f}, 50) * CASE WHEN count({f}) OVER () > 0 THEN {w} ELSE 0 END" for f, w in fs.items()) + ") / (" + " + ".join(f"CASE WHEN count({f}) OVER () > 0 THEN {w} ELSE 0 END" for f, w in fs.items()) + f") AS {g}" for g, fs in GROUPS.items())}, ceiling_streak FROM p)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means of percentile ranks by group. Ranks are over all symbols of one date: one row each."""
    f = factors(spark, d).withColumn("all", F.lit(0))
    p = f.select("symbol", "sector", "ceiling_streak", "all", *[rank_pct(F.col(c), "all").alias(c) for c in _USED])
    has = {c: F.when(F.count(c).over(Window.partitionBy("all")) > 0, 1.0).otherwise(0.0) for c in _USED}
    group = lambda fs: sum(F.coalesce(F.col(c), F.lit(50.0)) * has[c] * w for c, w in fs.items()) / sum(has[c] * w for c, w in fs.items())
    return p.select("symbol", "sector", "ceiling_streak", "all", *[group(fs).alias(g) for g, fs in GROUPS.items()])


@query("sector_group_scores", SQL_SCORES + """, v AS (SELECT *, CASE WHEN ceiling_streak >= 0.3 THEN least(momentum, 60) ELSE momentum END AS capped FROM scores), c AS (SELECT *, 0.4 * value + 0.4 * quality + 0.2 * capped AS v1 FROM v)
SELECT symbol, round(value, 4) AS value, round(quality, 4) AS quality, round(capped, 4) AS momentum, round((rank() OVER (ORDER BY round(v1, 8)) + (count(*) OVER (PARTITION BY round(v1, 8)) - 1) / 2.0) / count(*) OVER () * 100, 4) AS composite FROM c""")
def sector_group_scores(spark: SparkSession, d: str) -> DataFrame:
    """Value, quality and momentum, the latter capped after a run of limit moves; their composite as a percentile."""
    s = scores(spark, d).withColumn("capped", F.when(F.col("ceiling_streak") >= 0.3, F.least("momentum", F.lit(60.0))).otherwise(F.col("momentum")))
    s = s.withColumn("v1", F.round(0.4 * F.col("value") + 0.4 * F.col("quality") + 0.2 * F.col("capped"), 8))
    return s.select("symbol", F.round("value", 4).alias("value"), F.round("quality", 4).alias("quality"), F.round("capped", 4).alias("momentum"), F.round(rank_pct(F.col("v1"), "all"), 4).alias("composite"))


#: Weights of the nine groups of the second composite, each here one factor's percentile.
NINE = (("pe_inv", 0.25), ("roe", 0.20), ("mom1", 0.03), ("mom3", 0.10), ("pb_inv", 0.02), ("mom6", 0.02), ("gross_margin", 0.02), ("altman", 0.28), ("piotroski", 0.08))


@query("composite_v2", f"{SQL_SCORES} SELECT symbol, round({' + '.join(f'{w} * coalesce({f}, 0)' for f, w in NINE)}, 4) AS composite FROM p")
def composite_v2(spark: SparkSession, d: str) -> DataFrame:
    """Nine weighted percentiles; what a symbol lacks counts 0."""
    f = factors(spark, d).withColumn("all", F.lit(0))
    p = f.select("symbol", *[rank_pct(F.col(c), "all").alias(c) for c, _ in NINE])
    return p.select("symbol", F.round(sum(w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in NINE), 4).alias("composite"))


#: Information coefficients by which factors are weighed, and direction.
ICS = {"roe": (0.077, 1), "book_to_market": (0.075, 1), "net_margin": (0.051, 1), "size": (0.040, -1), "growth": (0.032, 1), "piotroski": (0.026, 1), "gross_margin": (0.023, 1), "vol20": (0.023, -1)}
_Z = "CASE WHEN count({x}) OVER (PARTITION BY sector) >= 5 THEN ({x} - avg({x}) OVER (PARTITION BY sector)) / nullif(stddev_samp({x}) OVER (PARTITION BY sector), 0) ELSE ({x} - avg({x}) OVER ()) / nullif(stddev_samp({x}) OVER (), 0) END * {s}"
SQL_WEIGHTED = f"""{SQL_FACTORS}, z AS (SELECT symbol, sector, foreign_net5, mom3, {", ".join(f"{_Z.format(x=f, s=s)} AS {f}" for f, (_, s) in ICS.items())} FROM factors),
weighted AS (SELECT symbol, sector, foreign_net5, mom3, ({" + ".join(f"coalesce({w} * greatest(-3, least(3, {f})), 0)" for f, (w, _) in ICS.items())}) / nullif({" + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {w} END" for f, (w, _) in ICS.items())}, 0) AS c FROM z)"""


def ic_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Deviations within the sector (of five names or more, else overall), weighed by what each symbol has."""
    f = factors(spark, d).withColumn("all", F.lit(0))
    own, whole = Window.partitionBy("sector"), Window.partitionBy("all")
    dev = lambda c, w: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))
    z = f.select("symbol", "sector", "foreign_net5", "mom3", *[(F.when(F.count(c).over(own) >= 5, dev(c, own)).otherwise(dev(c, whole)) * s).alias(c) for c, (_, s) in ICS.items()])
    total = sum(F.coalesce(w * F.greatest(F.lit(-3.0), F.least(F.lit(3.0), c)), F.lit(0.0)) for c, (w, _) in ICS.items() for c in [F.col(c)])
    weight = sum(F.when(F.col(c).isNull(), 0.0).otherwise(w) for c, (w, _) in ICS.items())
    return z.select("symbol", "sector", "foreign_net5", "mom3", F.try_divide(total, weight).alias("c"))


@query("ic_weighted_composite", f"{SQL_WEIGHTED} SELECT symbol, round(c, 6) AS composite FROM weighted")
def ic_weighted_composite(spark: SparkSession, d: str) -> DataFrame:
    return ic_weighted(spark, d).select("symbol", r6("c").alias("composite"))


@query("confidence_gate", f"""{SQL_WEIGHTED}, h AS (SELECT symbol, greatest(0, least(100, (c + 3) / 6 * 100)) AS pct, coalesce(mom3 > 0, false) AS technical, foreign_net5 FROM weighted)
SELECT symbol, round(pct, 4) AS pct, round(least(100, pct * CASE WHEN technical THEN 1.05 ELSE 1 END * CASE WHEN foreign_net5 < -10 THEN 0.85 ELSE 1 END), 4) AS confidence, CASE WHEN pct >= 60 THEN 'PASS' ELSE 'HOLD' END AS gate FROM h""")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    g = ic_weighted(spark, d).withColumn("pct", F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("c") + 3) / 6 * 100)))
    # The technical side agrees where the last quarter rose.
    boost = F.when(F.col("mom3") > 0, 1.05).otherwise(1.0) * F.when(F.col("foreign_net5") < -10, 0.85).otherwise(1.0)
    return g.select("symbol", F.round("pct", 4).alias("pct"), F.round(F.least(F.lit(100.0), F.col("pct") * boost), 4).alias("confidence"), F.when(F.col("pct") >= 60, "PASS").otherwise("HOLD").alias("gate"))


_PANEL = f"""{RETURNS}, {SQL_STOCKS}, k AS (SELECT ret.symbol, date, sector, r AS factor, lead(close, 2) OVER (PARTITION BY ret.symbol ORDER BY date) / nullif(lead(close) OVER (PARTITION BY ret.symbol ORDER BY date), 0) - 1 AS forward FROM ret JOIN stocks ON stocks.symbol = ret.symbol),
panel AS (SELECT * FROM k WHERE factor IS NOT NULL AND forward IS NOT NULL)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Last return as a factor, and the return from the next bar to the one after it."""
    w = series("symbol", "date")
    k = returns(spark, d).join(stocks(spark, d), "symbol").withColumn("forward", F.try_divide(F.lead("close", 2).over(w), F.lead("close").over(w)) - 1)
    return k.select("symbol", "date", "sector", F.col("r").alias("factor"), "forward").filter("factor IS NOT NULL AND forward IS NOT NULL")


_RANK = "rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"


@query("winsorised_ic", _PANEL + f""", q AS (SELECT date, quantile_cont(factor, 0.01) AS lo, quantile_cont(factor, 0.99) AS hi FROM panel GROUP BY date), c AS (SELECT date, greatest(lo, least(hi, factor)) AS factor, forward FROM panel JOIN q USING (date)), r AS (SELECT date, {_RANK.format(x="factor")} AS a, {_RANK.format(x="forward")} AS b FROM c)
SELECT date, count(*) AS n, round(corr(a, b), 6) AS ic FROM r GROUP BY date HAVING count(*) >= 5""", dates=("date",))
def winsorised_ic(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    q = p.groupBy("date").agg(F.percentile("factor", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    c = p.join(q, "date").select("date", F.greatest(F.col("q")[0], F.least(F.col("q")[1], "factor")).alias("factor"), "forward")
    r = c.select("date", rank_average(F.col("factor"), "date").alias("a"), rank_average(F.col("forward"), "date").alias("b"))
    return r.groupBy("date").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("a", "b")).alias("ic")).filter("n >= 5")


@query("sector_neutral_ic", _PANEL + f""", s AS (SELECT date, factor - CASE WHEN count(*) OVER w >= 5 THEN avg(factor) OVER w ELSE avg(factor) OVER (PARTITION BY date) END AS factor, forward FROM panel WINDOW w AS (PARTITION BY date, sector)), r AS (SELECT date, {_RANK.format(x="factor")} AS a, {_RANK.format(x="forward")} AS b FROM (SELECT date, round(factor, 9) AS factor, forward FROM s))
SELECT date, count(*) AS n, round(corr(a, b), 6) AS ic FROM r GROUP BY date HAVING count(*) >= 5""", dates=("date",))
def sector_neutral_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation after the mean of the sector (of five names or more, else of all) is taken off."""
    w = Window.partitionBy("date", "sector")
    s = panel(spark, d).withColumn("factor", F.round(F.col("factor") - F.when(F.count(F.lit(1)).over(w) >= 5, F.avg("factor").over(w)).otherwise(F.avg("factor").over(Window.partitionBy("date"))), 9))
    r = s.select("date", rank_average(F.col("factor"), "date").alias("a"), rank_average(F.col("forward"), "date").alias("b"))
    return r.groupBy("date").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("a", "b")).alias("ic")).filter("n >= 5")


@query("factor_coverage", f"{SQL_FACTORS} SELECT unnest([{', '.join(repr(n) for n in FACTORS)}]) AS factor, unnest([{', '.join(f'count({n})' for n in FACTORS)}]) AS present, unnest([{', '.join(f'round(100.0 * count({n}) / count(*), 4)' for n in FACTORS)}]) AS share FROM factors")
def factor_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols have each factor: one aggregate for all of them."""
    one = factors(spark, d).agg(F.count(F.lit(1)).alias("all"), *[F.count(n).alias(n) for n in FACTORS])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("present")) for n in FACTORS])).alias("c")
    return one.select("all", rows).select("c.factor", "c.present", F.round(100.0 * F.col("c.present") / F.col("all"), 4).alias("share"))


@query("imputed_panel", _PANEL + """, h AS (SELECT symbol, date, sector, CASE WHEN symbol % 3 = 0 AND month(date) % 2 = 0 THEN NULL ELSE factor END AS x FROM panel), f AS (SELECT symbol, date, coalesce(x, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), median(x) OVER (PARTITION BY date, sector), median(x) OVER (PARTITION BY date), 0) AS x FROM h)
SELECT symbol, date, round(x, 6) AS filled, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 6) AS z FROM f WINDOW w AS (PARTITION BY date)""", dates=("date",))
def imputed_panel(spark: SparkSession, d: str) -> DataFrame:
    """Gaps take the symbol's value before, else the sector's median of the date, else all; then deviations by date."""
    h = panel(spark, d).withColumn("x", F.when(~((F.col("symbol") % 3 == 0) & (F.month("date") % 2 == 0)), F.col("factor")))
    before = F.last("x", ignorenulls=True).over(series("symbol", "date").rowsBetween(Window.unboundedPreceding, 0))
    f = h.withColumn("x", F.coalesce("x", before, F.median("x").over(Window.partitionBy("date", "sector")), F.median("x").over(Window.partitionBy("date")), F.lit(0.0)))
    w = Window.partitionBy("date")
    return f.select("symbol", "date", r6("x").alias("filled"), r6(F.try_divide(F.col("x") - F.avg("x").over(w), F.stddev_samp("x").over(w))).alias("z"))


_SHAPES = ("piotroski", "holiday", "forced_selling", "foreign_room", "roe", "altman")


@query("distribution_kinds", f"{SQL_FACTORS}, v AS (SELECT unnest([{', '.join(repr(n) for n in _SHAPES)}]) AS factor, unnest([{', '.join(_SHAPES)}]) AS x FROM factors) SELECT factor, count(DISTINCT x) AS distinct_values, CASE WHEN count(DISTINCT x) <= 2 THEN 'binary' WHEN count(DISTINCT x) <= 10 AND bool_and(x * 2 = floor(x * 2)) THEN 'ordinal' ELSE 'continuous' END AS kind FROM v WHERE x IS NOT NULL GROUP BY factor")
def distribution_kinds(spark: SparkSession, d: str) -> DataFrame:
    v = factors(spark, d).select(F.explode(F.create_map(*[x for n in _SHAPES for x in (F.lit(n), F.col(n))])).alias("factor", "x")).filter("x IS NOT NULL")
    many, halves = F.countDistinct("x"), F.bool_and(F.col("x") * 2 == F.floor(F.col("x") * 2))
    return v.groupBy("factor").agg(many.alias("distinct_values"), F.when(many <= 2, "binary").when((many <= 10) & halves, "ordinal").otherwise("continuous").alias("kind"))


@query("orthogonal_factors", f"""{SQL_FACTORS}, a AS (SELECT symbol, roe AS q1, net_margin, mom1 FROM factors WHERE roe IS NOT NULL AND net_margin IS NOT NULL AND mom1 IS NOT NULL), s1 AS (SELECT regr_slope(net_margin, q1) AS b, regr_intercept(net_margin, q1) AS c FROM a), b AS (SELECT symbol, q1, net_margin - b * q1 - c AS q2, mom1 FROM a, s1),
s2 AS (SELECT regr_slope(mom1, q1) AS b1, regr_slope(mom1, q2) AS b2, avg(mom1) AS m, avg(q1) AS m1, avg(q2) AS m2 FROM b) SELECT symbol, round(q1, 6) AS q1, round(q2, 6) AS q2, round(mom1 - m - b1 * (q1 - m1) - b2 * (q2 - m2), 6) AS q3 FROM b, s2""")
def orthogonal_factors(spark: SparkSession, d: str) -> DataFrame:
    """Three factors in order, each less what those before it explain. The slopes are one row."""
    a = factors(spark, d).select("symbol", F.col("roe").alias("q1"), "net_margin", "mom1").dropna()
    s1 = a.agg(F.regr_slope("net_margin", "q1").alias("b"), F.regr_intercept("net_margin", "q1").alias("c"))
    b = a.crossJoin(F.broadcast(s1)).select("symbol", "q1", (F.col("net_margin") - F.col("b") * F.col("q1") - F.col("c")).alias("q2"), "mom1")
    s2 = b.agg(F.regr_slope("mom1", "q1").alias("b1"), F.regr_slope("mom1", "q2").alias("b2"), F.avg("mom1").alias("m"), F.avg("q1").alias("m1"), F.avg("q2").alias("m2"))
    q3 = F.col("mom1") - F.col("m") - F.col("b1") * (F.col("q1") - F.col("m1")) - F.col("b2") * (F.col("q2") - F.col("m2"))
    return b.crossJoin(F.broadcast(s2)).select("symbol", r6("q1").alias("q1"), r6("q2").alias("q2"), r6(q3).alias("q3"))


@query("win_rate_shrinkage", RETURNS + """, w AS (SELECT symbol, count(*) AS n, count(*) FILTER (r > 0) AS wins FROM ret WHERE r IS NOT NULL GROUP BY symbol), p AS (SELECT sum(wins) / CAST(sum(n) AS DOUBLE) AS prior FROM w) SELECT symbol, n, round(wins / CAST(n AS DOUBLE), 6) AS raw, round((wins + 20 * prior) / (n + 20), 6) AS shrunk FROM w, p""")
def win_rate_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    """Win rates drawn to the overall one by the weight of twenty trades."""
    w = returns(spark, d).filter("r IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("wins"))
    p = w.agg((F.sum("wins") / F.sum("n")).alias("prior"))
    return w.crossJoin(F.broadcast(p)).select("symbol", "n", r6(F.col("wins") / F.col("n")).alias("raw"), r6((F.col("wins") + 20 * F.col("prior")) / (F.col("n") + 20)).alias("shrunk"))


@query("brinson_attribution", f"""{RETURNS}, {SQL_STOCKS}, k AS (SELECT date, sector, r, 1.0 / count(*) OVER (PARTITION BY date) AS wb, market_cap / sum(market_cap) OVER (PARTITION BY date) AS wp FROM ret JOIN stocks USING (symbol) WHERE r IS NOT NULL AND market_cap IS NOT NULL),
s AS (SELECT date, sector, sum(wb) AS wb, sum(wp) AS wp, sum(wb * r) / sum(wb) AS rb, sum(wp * r) / nullif(sum(wp), 0) AS rp FROM k GROUP BY ALL), t AS (SELECT date, sum(wb * rb) AS total FROM s GROUP BY date)
SELECT date, round(sum((wp - wb) * (rb - total)), 6) AS allocation, round(sum(wb * (rp - rb)), 6) AS selection, round(sum((wp - wb) * (rp - rb)), 6) AS interaction FROM s JOIN t USING (date) GROUP BY date""", dates=("date",))
def brinson_attribution(spark: SparkSession, d: str) -> DataFrame:
    """What a capital-weighted portfolio gains on an equally weighted one, by choice of sectors and within them."""
    by = Window.partitionBy("date")
    k = returns(spark, d).filter("r IS NOT NULL").join(stocks(spark, d).filter("market_cap IS NOT NULL"), "symbol").select("date", "sector", "r", (1.0 / F.count(F.lit(1)).over(by)).alias("wb"), (F.col("market_cap") / F.sum("market_cap").over(by)).alias("wp"))
    s = k.groupBy("date", "sector").agg(F.sum("wb").alias("b"), F.sum("wp").alias("p"), (F.sum(F.col("wb") * F.col("r")) / F.sum("wb")).alias("rb"), F.try_divide(F.sum(F.col("wp") * F.col("r")), F.sum("wp")).alias("rp"))
    s = s.withColumn("total", F.sum(F.col("b") * F.col("rb")).over(by))
    part = lambda e: r6(F.sum(e))
    shift, pick = F.col("p") - F.col("b"), F.col("rp") - F.col("rb")
    return s.groupBy("date").agg(part(shift * (F.col("rb") - F.col("total"))).alias("allocation"), part(F.col("b") * pick).alias("selection"), part(shift * pick).alias("interaction"))


_WEIGHTS = [1.0]
for _k in range(1, 10):
    _WEIGHTS.append(-_WEIGHTS[-1] * (0.4 - _k + 1) / _k)


@query("fractional_differences", f"WITH {SQL_BARS}, l AS (SELECT symbol, date, ln(close) AS x FROM bars) SELECT symbol, date, round({' + '.join(f'{w!r} * lag(x, {k}) OVER w' if k else f'{w!r} * x' for k, w in enumerate(_WEIGHTS))}, 6) AS d FROM l WINDOW w AS (PARTITION BY symbol ORDER BY date)", dates=("date",))
def fractional_differences(spark: SparkSession, d: str) -> DataFrame:
    """Differences of order 0.4 with ten weights: a weighted sum of earlier rows."""
    w = series("symbol", "date")
    l = bars(spark, d).withColumn("x", F.ln("close"))
    return l.select("symbol", "date", r6(sum(c * (F.lag("x", k).over(w) if k else F.col("x")) for k, c in enumerate(_WEIGHTS))).alias("d"))


def _product(x: Column, w) -> Column:
    return F.exp(F.sum(F.log1p(x)).over(w)) - 1


_FORGE = {
    "ret1": "r", "ret5": "exp(sum(ln(1 + r)) OVER w5) - 1", "vol20": "stddev_samp(r) OVER w20", "skew": "avg(r * r * r) OVER w20", "range20": "(max(high) OVER w20 - min(low) OVER w20) / close", "volume_z": "(volume - avg(volume) OVER w20) / nullif(stddev_samp(volume) OVER w20, 0)",
    "gap": "open / nullif(prev, 0) - 1", "body": "(close - open) / nullif(high - low, 0)", "upper": "(high - greatest(open, close)) / nullif(high - low, 0)", "beta20": "covar_samp(r, m) OVER w20 / nullif(var_samp(m) OVER w20, 0)", "relative": "r - m", "up_share": "avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) OVER w20",
}


def forged(rows: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Features of written bars with returns, and ``more``, which is taken from all bars; the market's mean is told to all tasks, a row a date."""
    more = more or {}
    w = series("symbol", "date")
    m = rows.groupBy("date").agg(F.avg("r").alias("m"))
    j = rows.withColumns(more).join(F.broadcast(m), "date").withColumn("prev", F.lag("close").over(w)).filter("r > -1")
    w5, w20, r, m = w.rowsBetween(-4, 0), w.rowsBetween(-19, 0), F.col("r"), F.col("m")
    spread = F.col("high") - F.col("low")
    out = {
        "ret1": r, "ret5": _product(r, w5), "vol20": F.stddev_samp("r").over(w20), "skew": F.avg(r * r * r).over(w20), "range20": (F.max("high").over(w20) - F.min("low").over(w20)) / F.col("close"), "volume_z": F.try_divide(F.col("volume") - F.avg("volume").over(w20), F.stddev_samp("volume").over(w20)),
        "gap": F.try_divide("open", "prev") - 1, "body": F.try_divide(F.col("close") - F.col("open"), spread), "upper": F.try_divide(F.col("high") - F.greatest("open", "close"), spread), "beta20": F.try_divide(F.covar_samp("r", "m").over(w20), F.var_samp("m").over(w20)), "relative": r - m, "up_share": F.avg(F.when(r > 0, 1.0).otherwise(0.0)).over(w20),
    }
    return j.select("symbol", "date", *[r6(x).alias(n) for n, x in out.items()], *more)


@query("feature_forge", RETURNS + f""", mk AS (SELECT date, avg(r) AS m FROM ret GROUP BY date), j AS (SELECT ret.*, m, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM ret JOIN mk USING (date)), k AS (SELECT * FROM j WHERE r > -1)
SELECT symbol, date, {", ".join(f"round({x}, 6) AS {n}" for n, x in _FORGE.items())} FROM k WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""", dates=("date",))
def feature_forge(spark: SparkSession, d: str) -> DataFrame:
    """Features of a bar for models: returns, shape, volume and the market beside it."""
    return forged(written(returns(spark, d)))


@query("hybrid_rank_stack", _PANEL + f""", k2 AS (SELECT symbol, date, factor, forward, {_RANK.format(x="factor")} AS a FROM panel), z AS (SELECT symbol, date, (a - avg(a) OVER w) / nullif(stddev_samp(a) OVER w, 0) AS rank_z, (factor - avg(factor) OVER w) / nullif(stddev_samp(factor) OVER w, 0) AS mom_z, avg(CASE WHEN factor > -0.5 THEN 1.0 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS survival FROM k2 WINDOW w AS (PARTITION BY date))
SELECT symbol, date, round(0.65 * rank_z + 0.35 * mom_z - CASE WHEN survival < 0.55 THEN 2 ELSE 0 END, 6) AS score FROM z""", dates=("date",))
def hybrid_rank_stack(spark: SparkSession, d: str) -> DataFrame:
    """Deviations of ranks and of momentum together, less two where survival is poor."""
    w = Window.partitionBy("date")
    k = panel(spark, d).withColumn("a", rank_average(F.col("factor"), "date"))
    dev = lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))
    z = k.withColumns({"rank_z": dev("a"), "mom_z": dev("factor"), "survival": F.avg(F.when(F.col("factor") > -0.5, 1.0).otherwise(0.0)).over(series("symbol", "date").rowsBetween(-9, 0))})
    return z.select("symbol", "date", r6(0.65 * F.col("rank_z") + 0.35 * F.col("mom_z") - F.when(F.col("survival") < 0.55, 2.0).otherwise(0.0)).alias("score"))


@query("model_risk_metrics", _PANEL + f""", r AS (SELECT date, {_RANK.format(x="factor")} AS a, {_RANK.format(x="forward")} AS b, factor > 0 AS said, forward > 0 AS came FROM panel), d AS (SELECT date, corr(a, b) AS ic, avg(CASE WHEN said = came THEN 1.0 ELSE 0 END) AS accuracy FROM r GROUP BY date HAVING count(*) >= 5),
y AS (SELECT year(date) AS year, count(*) AS dates, avg(ic) AS ic, avg(accuracy) AS accuracy FROM d GROUP BY 1) SELECT year, dates, round(ic, 6) AS ic, round(accuracy, 6) AS accuracy, round(ic - lag(ic) OVER (ORDER BY year), 6) AS decay, coalesce(ic < 0 OR accuracy < 0.45 OR ic - lag(ic) OVER (ORDER BY year) < -0.1, false) AS retrain FROM y""")
def model_risk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and rank correlation by year, their decay, and whether to train anew. Years are few."""
    p = panel(spark, d)
    r = p.select("date", rank_average(F.col("factor"), "date").alias("a"), rank_average(F.col("forward"), "date").alias("b"), ((F.col("factor") > 0) == (F.col("forward") > 0)).alias("right"))
    day = r.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("ic"), F.avg(F.when(F.col("right"), 1.0).otherwise(0.0)).alias("accuracy")).filter("n >= 5")
    y = day.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("ic"), F.avg("accuracy").alias("accuracy"))
    decay = F.col("ic") - F.lag("ic").over(Window.orderBy("year"))
    y = y.withColumn("decay", decay)
    return y.select("year", "dates", r6("ic").alias("ic"), r6("accuracy").alias("accuracy"), r6("decay").alias("decay"), F.coalesce((F.col("ic") < 0) | (F.col("accuracy") < 0.45) | (F.col("decay") < -0.1), F.lit(False)).alias("retrain"))


@query("probability_lookup", _PANEL + """, b AS (SELECT symbol, date, CAST(floor((factor + 1) / 0.5) AS INT) AS bin, forward > 0 AS won, forward FROM panel), p AS (SELECT bin, count(*) AS n, avg(CASE WHEN won THEN 1.0 ELSE 0 END) AS p, avg(forward) FILTER (won) AS gain, -avg(forward) FILTER (NOT won) AS loss FROM b GROUP BY bin)
SELECT bin, n, round(CASE WHEN n >= 10 THEN p ELSE 0.5 END, 6) AS probability, round(gain / nullif(loss, 0), 6) AS ratio, n >= 10 AND p > 0.5 AS eligible FROM p""")
def probability_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Win rates by size of the signal; bins with few trades tell nothing."""
    b = panel(spark, d).withColumns({"bin": F.floor((F.col("factor") + 1) / 0.5).cast("int"), "won": F.col("forward") > 0})
    p = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("won"), 1.0).otherwise(0.0)).alias("p"), F.avg(F.when(F.col("won"), F.col("forward"))).alias("gain"), (-F.avg(F.when(~F.col("won"), F.col("forward")))).alias("loss"))
    return p.select("bin", "n", r6(F.when(F.col("n") >= 10, F.col("p")).otherwise(0.5)).alias("probability"), r6(F.try_divide("gain", "loss")).alias("ratio"), ((F.col("n") >= 10) & (F.col("p") > 0.5)).alias("eligible"))


@query("target_price_blend", f"""{SQL_FACTORS}, t AS (SELECT m.symbol, c0, 4 * latest.income / nullif(market_cap / c0, 0) * 12 AS by_earnings, latest.equity / nullif(market_cap / c0, 0) * 1.2 AS by_book, c6 * 1.05 AS by_trend FROM m JOIN stocks USING (symbol) JOIN latest USING (symbol)),
b AS (SELECT *, (CASE WHEN by_earnings > 0 THEN 0.5 * by_earnings ELSE 0 END + CASE WHEN by_book > 0 THEN 0.3 * by_book ELSE 0 END + CASE WHEN by_trend > 0 THEN 0.2 * by_trend ELSE 0 END) / nullif(CASE WHEN by_earnings > 0 THEN 0.5 ELSE 0 END + CASE WHEN by_book > 0 THEN 0.3 ELSE 0 END + CASE WHEN by_trend > 0 THEN 0.2 ELSE 0 END, 0) AS target FROM t)
SELECT symbol, round(target, 4) AS target, round(target / nullif(c0, 0) - 1, 6) AS upside, CASE WHEN target / c0 - 1 > 0.15 THEN 'BUY' WHEN target / c0 - 1 < -0.1 THEN 'SELL' ELSE 'HOLD' END AS view FROM b""")
def target_price_blend(spark: SparkSession, d: str) -> DataFrame:
    """Targets by earnings, book value and trend, weighed by those that exist."""
    b = bars(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    c = b.groupBy("symbol").agg(F.max(F.when(F.col("back") == 1, F.col("close"))).alias("c0"), F.max(F.when(F.col("back") == 7, F.col("close"))).alias("c6"))
    j = c.join(stocks(spark, d), "symbol").join(latest_statements(spark, d), "symbol")
    shares = F.try_divide("market_cap", "c0")
    t = j.select("symbol", "c0", (F.try_divide(4 * F.col("income"), shares) * 12).alias("by_earnings"), (F.try_divide("equity", shares) * 1.2).alias("by_book"), (F.col("c6") * 1.05).alias("by_trend"))
    parts = (("by_earnings", 0.5), ("by_book", 0.3), ("by_trend", 0.2))
    have = lambda c, x: F.when(F.col(c) > 0, x).otherwise(0.0)
    t = t.withColumn("target", F.try_divide(sum(have(c, w * F.col(c)) for c, w in parts), sum(have(c, F.lit(w)) for c, w in parts)))
    up = F.try_divide("target", "c0") - 1
    return t.select("symbol", F.round("target", 4).alias("target"), r6(up).alias("upside"), F.when(up > 0.15, "BUY").when(up < -0.1, "SELL").otherwise("HOLD").alias("view"))


_SIGNALS = {"momentum": "r", "size": "ln(market_cap)", "turnover": "ln(1 + volume * close)", "range": "(high - low) / close", "reversal": "-r"}


@query("factor_verdicts", f"""{RETURNS}, {SQL_STOCKS}, k AS (SELECT ret.*, market_cap, lead(close, 2) OVER w / nullif(lead(close) OVER w, 0) - 1 AS forward FROM ret JOIN stocks USING (symbol) WINDOW w AS (PARTITION BY ret.symbol ORDER BY date)),
v AS (SELECT date, forward, unnest([{", ".join(f"'{n}'" for n in _SIGNALS)}]) AS factor, unnest([{", ".join(_SIGNALS.values())}]) AS x FROM k), p AS (SELECT * FROM v WHERE x IS NOT NULL AND forward IS NOT NULL),
i AS (SELECT factor, date, corr(a, b) AS ic FROM (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, date ORDER BY forward) + (count(*) OVER (PARTITION BY factor, date, forward) - 1) / 2.0 AS b FROM p) GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT factor, count(ic) AS n, avg(ic) AS mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ratio, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t FROM i GROUP BY factor)
SELECT factor, n, round(mean, 6) AS mean, round(ratio, 6) AS ratio, round(t, 6) AS t, CASE WHEN t >= 2 AND mean > 0.02 THEN 'ALIVE' WHEN t <= -2 AND mean < -0.02 THEN 'REVERSED' WHEN abs(t) >= 1.5 THEN 'MARGINAL' WHEN abs(mean) >= 0.01 THEN 'WEAK' ELSE 'DEAD' END AS verdict FROM s""")
def factor_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Information coefficients of several signals over all dates, and what they amount to."""
    w = series("symbol", "date")
    k = returns(spark, d).join(stocks(spark, d), "symbol").withColumn("forward", F.try_divide(F.lead("close", 2).over(w), F.lead("close").over(w)) - 1)
    v = k.select("date", "forward", F.explode(F.create_map(*[e for n, x in _SIGNALS.items() for e in (F.lit(n), F.expr(x).cast("double"))])).alias("factor", "x")).filter("x IS NOT NULL AND forward IS NOT NULL")
    ranked = v.select("factor", "date", rank_average(F.col("x"), "factor", "date").alias("a"), rank_average(F.col("forward"), "factor", "date").alias("b"))
    i = ranked.groupBy("factor", "date").agg(F.count(F.lit(1)).alias("names"), F.corr("a", "b").alias("ic")).filter("names >= 5")
    ratio = F.try_divide(F.avg("ic"), F.stddev_samp("ic"))
    s = i.groupBy("factor").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), ratio.alias("ratio"), (ratio * F.sqrt(F.count("ic"))).alias("t"))
    t, mean = F.col("t"), F.col("mean")
    verdict = F.when((t >= 2) & (mean > 0.02), "ALIVE").when((t <= -2) & (mean < -0.02), "REVERSED").when(F.abs(t) >= 1.5, "MARGINAL").when(F.abs(mean) >= 0.01, "WEAK").otherwise("DEAD")
    return s.select("factor", "n", r6("mean").alias("mean"), r6("ratio").alias("ratio"), r6("t").alias("t"), verdict.alias("verdict"))


@query("contagion_features", f"""{RETURNS}, {SQL_STOCKS}, l AS (SELECT symbol, sector, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC NULLS LAST, symbol) = 1 AS leads FROM stocks), x AS (SELECT ret.symbol, date, r, sector, leads FROM ret JOIN l USING (symbol) WHERE r IS NOT NULL),
d AS (SELECT sector, date, r AS shock, lag(r) OVER w AS shock1, lag(r, 2) OVER w AS shock2 FROM x WHERE leads WINDOW w AS (PARTITION BY sector ORDER BY date)), s AS (SELECT sector, date, avg(r) AS mean, avg(CASE WHEN r > 0.05 THEN 1.0 ELSE 0 END) AS surge FROM x GROUP BY ALL)
SELECT symbol, date, round(shock1, 6) AS shock1, round(shock2, 6) AS shock2, round(r - mean, 6) AS relative, round(shock1 - r, 6) AS catch_up, round(surge, 6) AS surge, leads FROM x JOIN s USING (sector, date) LEFT JOIN d USING (sector, date)""", dates=("date",))
def contagion_features(spark: SparkSession, d: str) -> DataFrame:
    """What a sector's leader did before, how a symbol stands to its sector, and how far it lags behind."""
    l = stocks(spark, d).withColumn("leads", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc_nulls_last("market_cap"), "symbol")) == 1)
    x = returns(spark, d).filter("r IS NOT NULL").select("symbol", "date", "r").join(l.select("symbol", "sector", "leads"), "symbol")
    w = Window.partitionBy("sector").orderBy("date")
    lead = x.filter("leads").select("sector", "date", F.lag("r").over(w).alias("shock1"), F.lag("r", 2).over(w).alias("shock2"))
    s = x.groupBy("sector", "date").agg(F.avg("r").alias("mean"), F.avg(F.when(F.col("r") > 0.05, 1.0).otherwise(0.0)).alias("surge"))
    j = x.join(s, ["sector", "date"]).join(lead, ["sector", "date"], "left")
    return j.select("symbol", "date", r6("shock1").alias("shock1"), r6("shock2").alias("shock2"), r6(F.col("r") - F.col("mean")).alias("relative"), r6(F.col("shock1") - F.col("r")).alias("catch_up"), r6("surge").alias("surge"), "leads")


@query("universe_refresh", f"""WITH {SQL_BARS}, y AS (SELECT symbol, year(date) AS year, avg(volume * close) AS adtv, count(*) AS n FROM bars GROUP BY ALL), m AS (SELECT *, n >= 6 AND adtv >= 4e5 AS member FROM y), c AS (SELECT symbol, year, member, lag(member) OVER (PARTITION BY symbol ORDER BY year) AS before FROM m)
SELECT symbol, year, CASE WHEN member AND coalesce(before, false) THEN 'KEPT' WHEN member THEN 'ADDED' WHEN before THEN 'REMOVED' ELSE 'OUTSIDE' END AS state FROM c""")
def universe_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Who enters and leaves the universe of liquid symbols from year to year."""
    y = bars(spark, d).groupBy("symbol", F.year("date").alias("year")).agg(F.avg(F.col("volume") * F.col("close")).alias("adtv"), F.count(F.lit(1)).alias("n"))
    m = y.withColumn("member", (F.col("n") >= 6) & (F.col("adtv") >= 4e5)).withColumn("before", F.coalesce(F.lag("member").over(Window.partitionBy("symbol").orderBy("year")), F.lit(False)))
    state = F.when(F.col("member") & F.col("before"), "KEPT").when(F.col("member"), "ADDED").when(F.col("before"), "REMOVED").otherwise("OUTSIDE")
    return m.select("symbol", "year", state.alias("state"))

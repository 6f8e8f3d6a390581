"""Risk of series and of the whole market: tails, drawdowns, breadth, herding, anomalies."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import change, last_n, rolling, series, so_far
from marketloom.functions.normal import normal_cdf, sql_normal_cdf
from marketloom.plans.catalog import query
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bars, load, stocks, trades

RETURNS = f"WITH {SQL_BARS}, ret AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM bars)"


def returns(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).withColumn("r", change(F.col("close"), series("symbol", "date")))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


@query("var_es_hist", RETURNS + """, o AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ret WHERE r IS NOT NULL),
t AS (SELECT *, CAST(floor((1 - 0.95) * n) AS BIGINT) AS cut FROM o)
SELECT symbol, n, round(CASE WHEN n < 30 THEN 0 ELSE abs(max(r) FILTER (k = cut)) END, 6) AS value_at_risk,
  round(CASE WHEN n < 30 THEN 0 WHEN cut > 0 THEN abs(avg(r) FILTER (k < cut)) ELSE abs(max(r) FILTER (k = cut)) END, 6) AS shortfall FROM t GROUP BY symbol, n, cut""")
def var_es_hist(spark: SparkSession, d: str) -> DataFrame:
    """Historical value at risk and mean of the losses beyond it, at 95 %; 0 with fewer than 30 returns."""
    w = Window.partitionBy("symbol")
    o = returns(spark, d).filter("r IS NOT NULL").select("symbol", "r", (F.row_number().over(w.orderBy("r")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    t = o.withColumn("cut", F.floor((1 - F.lit(0.95)) * F.col("n")))
    at, below = F.max(F.when(F.col("k") == F.col("cut"), F.col("r"))), F.avg(F.when(F.col("k") < F.col("cut"), F.col("r")))
    few = F.col("n") < 30
    return t.groupBy("symbol", "n", "cut").agg(
        r6(F.when(few, 0.0).otherwise(F.abs(at))).alias("value_at_risk"),
        r6(F.when(few, 0.0).when(F.col("cut") > 0, F.abs(below)).otherwise(F.abs(at))).alias("shortfall"),
    ).drop("cut")


#: Shortfall over deviation of a Student t of 5 degrees at 2.5 %, the deviation assumed without data, and losses of three stress scenarios with their weights.
T_MULTIPLE, DEFAULT_SIGMA = 3.37, 0.014
STRESS = ((0.50, "0.05 * beta * 1.2"), (0.30, "0.12 * least(beta, 1.3)"), (0.20, "0.1351"))
STRESS_SQL = " + ".join(f"{w} * {s}" for w, s in STRESS)


@query("tail_es", RETURNS + f""", m AS (SELECT date, avg(r) AS m FROM ret GROUP BY 1),
o AS (SELECT symbol, r, m, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ret JOIN m USING (date) WHERE r IS NOT NULL),
a AS (SELECT symbol, n, avg(r) FILTER (k <= greatest(1, floor((1 - 0.975) * n))) AS tail, count(*) FILTER (r < 0) AS falls, sqrt(avg(r * r) FILTER (r < 0)) AS down, stddev_pop(r) AS spread, regr_slope(r, m) AS beta FROM o GROUP BY symbol, n)
SELECT symbol, n, CASE WHEN n < 30 THEN 0.035 ELSE round(abs(tail), 4) END AS historical, CASE WHEN n >= 500 THEN 'VALID' ELSE 'ESTIMATE' END AS status,
  round({T_MULTIPLE} * CASE WHEN n < 10 THEN {DEFAULT_SIGMA} WHEN falls > 5 THEN down * 1.25 ELSE spread END, 4) AS student, round({STRESS_SQL}, 4) AS stress FROM a""")
def tail_es(spark: SparkSession, d: str) -> DataFrame:
    """Shortfall at 97.5 % three ways: historical, Student t around the downside deviation, and weighted stress losses by beta."""
    rows = returns(spark, d).filter("r IS NOT NULL")
    rows = rows.join(rows.groupBy("date").agg(F.avg("r").alias("m")), "date")
    w = Window.partitionBy("symbol")
    o = rows.select("symbol", "r", "m", F.row_number().over(w.orderBy("r")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    r = F.col("r")
    cut = F.greatest(F.lit(1), F.floor((1 - F.lit(0.975)) * F.col("n")))
    a = o.groupBy("symbol", "n").agg(
        F.avg(F.when(F.col("k") <= cut, r)).alias("tail"), F.count_if(r < 0).alias("falls"), F.sqrt(F.avg(F.when(r < 0, r * r))).alias("down"),
        F.stddev_pop("r").alias("spread"), F.regr_slope("r", "m").alias("beta"),
    )
    sigma = F.when(F.col("n") < 10, DEFAULT_SIGMA).when(F.col("falls") > 5, F.col("down") * 1.25).otherwise(F.col("spread"))
    return a.select(
        "symbol", "n", F.when(F.col("n") < 30, 0.035).otherwise(F.round(F.abs("tail"), 4)).alias("historical"),
        F.when(F.col("n") >= 500, "VALID").otherwise("ESTIMATE").alias("status"),
        F.round(T_MULTIPLE * sigma, 4).alias("student"), F.round(F.expr(STRESS_SQL), 4).alias("stress"),
    )


#: Drawdown from which a tier holds, its name, share of exposure kept and least cash.
TIERS = ((15, "RED", 0.25, 75.0), (10, "ORANGE", 0.5, 50.0), (5, "YELLOW", 0.75, 25.0), (3, "ALERT", 0.9, 15.0))


@query("drawdown_tiers", f"""WITH {SQL_BARS}, p AS (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM bars), x AS (SELECT *, greatest(0, (peak - close) / peak * 100) AS fall FROM p)
SELECT symbol, date, round(peak, 6) AS peak, round(fall, 4) AS fall, CASE {" ".join(f"WHEN fall >= {t} THEN '{n}'" for t, n, _, _ in TIERS)} ELSE 'GREEN' END AS tier,
  CASE {" ".join(f"WHEN fall >= {t} THEN {s}" for t, _, s, _ in TIERS)} ELSE 1.0 END AS exposure, CASE {" ".join(f"WHEN fall >= {t} THEN {c}" for t, _, _, c in TIERS)} ELSE 10.0 END AS cash FROM x""", dates=("date",))
def drawdown_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Fall from the running peak, and what it does to exposure and cash."""
    b = bars(spark, d).withColumn("peak", F.max("close").over(so_far(series("symbol", "date"))))
    b = b.withColumn("fall", F.greatest(F.lit(0.0), (F.col("peak") - F.col("close")) / F.col("peak") * 100))

    def ladder(k: int, last: object) -> Column:
        out = F.when(F.col("fall") >= TIERS[0][0], TIERS[0][k])
        for t in TIERS[1:]:
            out = out.when(F.col("fall") >= t[0], t[k])
        return out.otherwise(last)

    return b.select("symbol", "date", r6("peak").alias("peak"), F.round("fall", 4).alias("fall"), ladder(1, "GREEN").alias("tier"), ladder(2, 1.0).alias("exposure"), ladder(3, 10.0).alias("cash"))


@query("distribution_days", f"""WITH {SQL_BARS}, x AS (SELECT *, lag(close) OVER w AS c1, lag(volume) OVER w AS v1, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, count(*) FILTER (close / c1 - 1 <= -0.002 AND volume > v1) AS days FROM x WHERE back <= 20 GROUP BY symbol""")
def distribution_days(spark: SparkSession, d: str) -> DataFrame:
    """Of the last 20 bars, those that fell by 0.2 % or more on more volume than the bar before."""
    w = series("symbol", "date")
    x = bars(spark, d).select("symbol", F.lag("close").over(w).alias("c1"), "close", "volume", F.lag("volume").over(w).alias("v1"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("back"))
    falls = (F.col("close") / F.col("c1") - 1 <= -0.002) & (F.col("volume") > F.col("v1"))
    return x.filter("back <= 20").groupBy("symbol").agg(F.count_if(falls).alias("days"))


_MARKET = RETURNS + """, over AS (SELECT date, symbol, close, r, volume, CASE WHEN count(close) OVER w20 = 20 THEN close > avg(close) OVER w20 END AS above FROM ret WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
market AS (SELECT date, avg(r) AS m, sum(volume) AS volume, 100.0 * count(*) FILTER (above) / nullif(count(above), 0) AS breadth FROM over GROUP BY date)"""


def market(spark: SparkSession, d: str) -> DataFrame:
    """Mean return, volume and share of symbols over their mean of 20 bars, by date: one row per date."""
    w = last_n(series("symbol", "date"), 20)
    above = F.when(F.count("close").over(w) == 20, F.col("close") > F.avg("close").over(w))
    x = returns(spark, d).withColumn("above", above)
    return x.groupBy("date").agg(F.avg("r").alias("m"), F.sum("volume").alias("volume"), (100.0 * F.count_if("above") / F.expr("nullif(count(above), 0)")).alias("breadth"))


@query("breadth_health", _MARKET + """, n AS (SELECT *, count(*) FILTER (falls) OVER (ORDER BY date ROWS 19 PRECEDING) AS days FROM (SELECT *, m <= -0.002 AND volume > lag(volume) OVER (ORDER BY date) AS falls FROM market))
SELECT date, days, round(breadth, 1) AS breadth, m >= -0.001 AND breadth < 35 AS diverges,
  CASE WHEN days >= 5 THEN 'CRITICAL_DISTRIBUTION' WHEN days >= 4 OR (m >= -0.001 AND breadth < 25) THEN 'DETERIORATING' WHEN breadth < 40 OR days = 3 THEN 'NEUTRAL' ELSE 'HEALTHY' END AS health FROM n WHERE breadth IS NOT NULL""", dates=("date",))
def breadth_health(spark: SparkSession, d: str) -> DataFrame:
    """Distribution days of the market and its breadth; dates are few, one row each."""
    by = Window.orderBy("date")
    n = market(spark, d).withColumn("falls", (F.col("m") <= -0.002) & (F.col("volume") > F.lag("volume").over(by)))
    n = n.withColumn("days", F.count(F.when(F.col("falls"), 1)).over(by.rowsBetween(-19, 0))).filter("breadth IS NOT NULL")
    calm, b, days = F.col("m") >= -0.001, F.col("breadth"), F.col("days")
    health = F.when(days >= 5, "CRITICAL_DISTRIBUTION").when((days >= 4) | (calm & (b < 25)), "DETERIORATING").when((b < 40) | (days == 3), "NEUTRAL").otherwise("HEALTHY")
    return n.select("date", "days", F.round("breadth", 1).alias("breadth"), (calm & (b < 35)).alias("diverges"), health.alias("health"))


@query("csad_herding", RETURNS + """, m AS (SELECT date, avg(r) AS m FROM ret GROUP BY 1), c AS (SELECT date, m, avg(abs(r - m)) AS y, abs(m) AS a, m * m AS s FROM ret JOIN m USING (date) WHERE r IS NOT NULL GROUP BY ALL),
v AS (SELECT *, count(*) OVER w AS n, var_pop(a) OVER w AS saa, var_pop(s) OVER w AS sss, covar_pop(a, s) OVER w AS sas, covar_pop(a, y) OVER w AS say, covar_pop(s, y) OVER w AS ssy FROM c WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)),
b AS (SELECT *, (saa * ssy - sas * say) / nullif(saa * sss - sas * sas, 0) AS curve FROM v WHERE n >= 20)
SELECT date, round(y, 6) AS csad, round(m, 6) AS market, round(curve, 4) AS curve,
  CASE WHEN m < -0.01 THEN CASE WHEN curve < -0.5 OR (y < 0.015 AND curve < 0) THEN 'PANIC_SELLING_HERDING' ELSE 'SECTOR_ROTATION' END
    WHEN m > 0.01 THEN CASE WHEN curve < -0.5 OR (y < 0.015 AND curve < 0) THEN 'FOMO_EUPHORIA_HERDING' ELSE 'NORMAL_BULL_DISPERSION' END ELSE 'BALANCED_DISPERSION' END AS state FROM b""", dates=("date",))
def csad_herding(spark: SparkSession, d: str) -> DataFrame:
    """Dispersion regressed on the market's move and its square over 60 dates; a negative curve is herding. One row a date."""
    rows = returns(spark, d).filter("r IS NOT NULL")
    m = rows.groupBy("date").agg(F.avg("r").alias("m"))
    c = rows.join(m, "date").groupBy("date", "m").agg(F.avg(F.abs(F.col("r") - F.col("m"))).alias("y")).withColumns({"a": F.abs("m"), "s": F.col("m") * F.col("m")})
    w = Window.orderBy("date").rowsBetween(-59, 0)
    saa, sss, sas = F.var_pop("a").over(w), F.var_pop("s").over(w), F.covar_pop("a", "s").over(w)
    say, ssy = F.covar_pop("a", "y").over(w), F.covar_pop("s", "y").over(w)
    c = c.withColumns({"n": F.count(F.lit(1)).over(w), "curve": F.try_divide(saa * ssy - sas * say, saa * sss - sas * sas)}).filter("n >= 20")
    herd = (F.col("curve") < -0.5) | ((F.col("y") < 0.015) & (F.col("curve") < 0))
    down, up = F.when(herd, "PANIC_SELLING_HERDING").otherwise("SECTOR_ROTATION"), F.when(herd, "FOMO_EUPHORIA_HERDING").otherwise("NORMAL_BULL_DISPERSION")
    state = F.when(F.col("m") < -0.01, down).when(F.col("m") > 0.01, up).otherwise("BALANCED_DISPERSION")
    return c.select("date", r6("y").alias("csad"), r6("m").alias("market"), F.round("curve", 4).alias("curve"), state.alias("state"))


@query("index_distortion", f"{RETURNS}, {SQL_STOCKS}" + """, k AS (SELECT date, symbol, r, r * market_cap / sum(market_cap) OVER (PARTITION BY date) AS part FROM ret JOIN stocks USING (symbol) WHERE r IS NOT NULL AND market_cap IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(part) DESC, symbol) AS n FROM k),
g AS (SELECT date, sum(part) AS move, sum(abs(part)) FILTER (n <= 3) / nullif(sum(abs(part)), 0) AS share, count(*) FILTER (r > 0) / nullif(CAST(count(*) FILTER (r < 0) AS DOUBLE), 0) AS ratio FROM o GROUP BY date)
SELECT date, round(move, 6) AS move, round(share, 4) AS share, round(ratio, 4) AS ratio, CASE WHEN move > 0.001 AND ratio < 0.45 AND share > 0.7 THEN 'GREEN_EXTERIOR_RED_CORE+MEGA_CAP_CONCENTRATION' WHEN move > 0.001 AND ratio < 0.45 THEN 'GREEN_EXTERIOR_RED_CORE' WHEN share > 0.7 THEN 'MEGA_CAP_CONCENTRATION' END AS kind FROM g""", dates=("date",))
def index_distortion(spark: SparkSession, d: str) -> DataFrame:
    """Share of the three largest contributions in the index's move, and moves that few symbols share."""
    by = Window.partitionBy("date")
    k = returns(spark, d).filter("r IS NOT NULL").join(stocks(spark, d).filter("market_cap IS NOT NULL"), "symbol")
    k = k.select("date", "symbol", "r", (F.col("r") * F.col("market_cap") / F.sum("market_cap").over(by)).alias("part"))
    size = F.abs("part")
    o = k.withColumn("n", F.row_number().over(by.orderBy(size.desc(), "symbol")))
    g = o.groupBy("date").agg(F.sum("part").alias("move"), F.try_divide(F.sum(F.when(F.col("n") <= 3, size)), F.sum(size)).alias("share"), F.try_divide(F.count_if(F.col("r") > 0), F.count_if(F.col("r") < 0)).alias("ratio"))
    green, large = (F.col("move") > 0.001) & (F.col("ratio") < 0.45), F.col("share") > 0.7
    kind = F.when(green & large, "GREEN_EXTERIOR_RED_CORE+MEGA_CAP_CONCENTRATION").when(green, "GREEN_EXTERIOR_RED_CORE").when(large, "MEGA_CAP_CONCENTRATION")
    return g.select("date", r6("move").alias("move"), F.round("share", 4).alias("share"), F.round("ratio", 4).alias("ratio"), kind.alias("kind"))


@query("tape_anomalies", f"""WITH {SQL_BARS}, x AS (SELECT *, volume / nullif(avg(volume) OVER w, 0) AS vr, avg(close) OVER w AS ma, min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS swing, high - low AS range, high - greatest(open, close) AS wick FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
SELECT symbol, date, round(vr, 4) AS volume_ratio, CASE WHEN vr >= 2.2 AND range / close < 0.018 THEN 'CHURNING_DISTRIBUTION' WHEN range > 0 AND wick / nullif(range, 0) >= 0.5 AND vr >= 1.8 THEN 'BEARISH_UPTHRUST'
  WHEN close < ma AND vr >= 1.5 THEN 'STRUCTURAL_BREAKDOWN' WHEN close < swing AND vr >= 1.2 THEN 'STRUCTURAL_BREAKDOWN' WHEN close < open AND (close - low) / nullif(range, 0) <= 0.2 AND vr >= 2 THEN 'SELLING_PRESSURE_CLIMAX' ELSE 'NONE' END AS anomaly FROM x""", dates=("date",))
def tape_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """What price and volume of a bar tell together; the first that fits."""
    w = series("symbol", "date")
    x = bars(spark, d).withColumns({"vr": F.try_divide("volume", F.avg("volume").over(last_n(w, 20))), "ma": F.avg("close").over(last_n(w, 20)), "swing": F.min("low").over(w.rowsBetween(-10, -1)), "range": F.col("high") - F.col("low"), "wick": F.col("high") - F.greatest("open", "close")})
    vr, close = F.col("vr"), F.col("close")
    kind = (
        F.when((vr >= 2.2) & (F.col("range") / close < 0.018), "CHURNING_DISTRIBUTION")
        .when((F.try_divide("wick", "range") >= 0.5) & (vr >= 1.8), "BEARISH_UPTHRUST")
        .when((close < F.col("ma")) & (vr >= 1.5), "STRUCTURAL_BREAKDOWN")
        .when((close < F.col("swing")) & (vr >= 1.2), "STRUCTURAL_BREAKDOWN")
        .when((close < F.col("open")) & (F.try_divide(close - F.col("low"), F.col("range")) <= 0.2) & (vr >= 2), "SELLING_PRESSURE_CLIMAX")
        .otherwise("NONE")
    )
    return x.select("symbol", "date", F.round("vr", 4).alias("volume_ratio"), kind.alias("anomaly"))


@query("closing_auction_anomalies", f"""WITH {SQL_BARS}, t AS (SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS date, last(quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS last_quantity, max(day) AS day, (sum(quantity) - last_quantity) / nullif(count(*) - 1, 0) AS usual FROM trades GROUP BY ALL),
x AS (SELECT symbol, date, last_quantity / nullif(usual, 0) AS ratio, close / open - 1 AS move, dayofweek(day) = 4 AND day(day) BETWEEN 15 AND 21 AS expiry FROM t JOIN bars USING (symbol, date))
SELECT symbol, date, round(ratio, 4) AS ratio, expiry, CASE WHEN ratio IS NULL THEN 'NORMAL' WHEN expiry AND ratio > 2 THEN CASE WHEN abs(move) > 0.03 THEN 'WARNING' ELSE 'INFO' END
  WHEN ratio > 3 OR (ratio > 2.2 AND abs(move) > 0.04) THEN 'CRITICAL' WHEN ratio > 2 OR abs(move) > 0.03 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM x""", dates=("date",))
def closing_auction_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """The last trade of a bar against its usual trade; the third Thursday of a month is an expiry."""
    t = trades(spark, d).withColumn("date", F.trunc("day", "month"))
    last = F.max_by("quantity", "at")
    t = t.groupBy("symbol", "date").agg(last.alias("last"), F.max("day").alias("day"), F.try_divide(F.sum("quantity") - last, F.count(F.lit(1)) - 1).alias("usual"), F.min_by("price", "at").alias("open"), F.max_by("price", "at").alias("close"))
    expiry = (F.dayofweek("day") == 5) & F.dayofmonth("day").between(15, 21)
    x = t.select("symbol", "date", F.try_divide("last", "usual").alias("ratio"), F.abs(F.col("close") / F.col("open") - 1).alias("move"), expiry.alias("expiry"))
    ratio, move = F.col("ratio"), F.col("move")
    status = F.when(ratio.isNull(), "NORMAL").when(F.col("expiry") & (ratio > 2), F.when(move > 0.03, "WARNING").otherwise("INFO"))
    status = status.when((ratio > 3) | ((ratio > 2.2) & (move > 0.04)), "CRITICAL").when((ratio > 2) | (move > 0.03), "WARNING").otherwise("NORMAL")
    return x.select("symbol", "date", F.round("ratio", 4).alias("ratio"), "expiry", status.alias("status"))


@query("macro_risk_score", _MARKET + """, rate AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS rate FROM orders GROUP BY 1), z AS (SELECT date, (rate - avg(rate) OVER ()) / stddev_samp(rate) OVER () AS z FROM rate),
j AS (SELECT market.date, breadth, z, CASE WHEN avg(m) OVER w > 0.01 THEN 'BULL' WHEN avg(m) OVER w < -0.01 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM market LEFT JOIN z ON z.date = market.date WINDOW w AS (ORDER BY market.date ROWS 2 PRECEDING)),
s AS (SELECT *, greatest(0, least(100, 50.0 + CASE WHEN z > 1 THEN 10 ELSE 0 END + CASE WHEN z > 1.5 THEN 15 ELSE 0 END + CASE WHEN breadth < 40 THEN 15 WHEN breadth > 80 THEN -5 ELSE 0 END + CASE regime WHEN 'BEAR' THEN 20 WHEN 'BULL' THEN -10 ELSE 0 END)) AS score FROM j),
k AS (SELECT *, CASE WHEN score <= 40 THEN 1.0 WHEN score >= 90 THEN 0.1 ELSE 1 - (score - 40) / 50 * 0.9 END AS part FROM s)
SELECT date, regime, round(score, 1) AS score, round(CASE WHEN regime = 'BEAR' OR breadth < 10 THEN least(part, 0.3) ELSE part END, 4) AS multiplier FROM k""", dates=("date",))
def macro_risk_score(spark: SparkSession, d: str) -> DataFrame:
    """0 (safe) to 100 from a macro series, breadth and regime; and the exposure it allows. One row a date."""
    rate = load(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")).agg(F.avg("o_totalprice").alias("rate"))
    whole = Window.partitionBy()
    z = rate.select("date", ((F.col("rate") - F.avg("rate").over(whole)) / F.stddev_samp("rate").over(whole)).alias("z"))
    mean = F.avg("m").over(Window.orderBy("date").rowsBetween(-2, 0))
    j = market(spark, d).withColumn("regime", F.when(mean > 0.01, "BULL").when(mean < -0.01, "BEAR").otherwise("SIDEWAYS")).join(z, "date", "left")
    add = lambda c, n: F.when(c, n).otherwise(0)
    b, regime = F.col("breadth"), F.col("regime")
    score = 50.0 + add(F.col("z") > 1, 10) + add(F.col("z") > 1.5, 15) + F.when(b < 40, 15).when(b > 80, -5).otherwise(0) + F.when(regime == "BEAR", 20).when(regime == "BULL", -10).otherwise(0)
    j = j.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    s = F.col("score")
    part = F.when(s <= 40, 1.0).when(s >= 90, 0.1).otherwise(1 - (s - 40) / 50 * 0.9)
    return j.select("date", "regime", F.round("score", 1).alias("score"), F.round(F.when((regime == "BEAR") | (b < 10), F.least(part, F.lit(0.3))).otherwise(part), 4).alias("multiplier"))


_NORM = NormalDist()
_EULER, _TRIALS = 0.57721566490153286, 1000
_BEST = (1 - _EULER) * _NORM.inv_cdf(1 - 1 / _TRIALS) + _EULER * _NORM.inv_cdf(1 - 1 / (_TRIALS * 2.718281828459045))

_PERFORMANCE = RETURNS + """, e AS (SELECT symbol, date, r, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY date)) AS equity FROM ret WHERE r IS NOT NULL AND r > -1),
f AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY date) - 1 AS fall FROM e),
g AS (SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS spread, sqrt(avg(least(r, 0) ** 2)) AS down, min(fall) AS fall, last(equity ORDER BY date) / first(equity ORDER BY date) AS growth, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS hit, sum(r) FILTER (r > 0) AS gains, -sum(r) FILTER (r < 0) AS losses FROM f GROUP BY symbol)"""


def performance(spark: SparkSession, d: str) -> DataFrame:
    w = series("symbol", "date")
    e = returns(spark, d).filter("r > -1").withColumn("equity", F.exp(F.sum(F.log1p("r")).over(so_far(w))))
    e = e.withColumn("fall", F.col("equity") / F.max("equity").over(so_far(w)) - 1)
    r = F.col("r")
    return e.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("spread"), F.sqrt(F.avg(F.least(r, F.lit(0.0)) ** 2)).alias("down"),
        F.min("fall").alias("fall"), (F.max_by("equity", "date") / F.min_by("equity", "date")).alias("growth"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit"),
        F.sum(F.when(r > 0, r)).alias("gains"), (-F.sum(F.when(r < 0, r))).alias("losses"),
    )


@query("backtest_metrics", _PERFORMANCE + """SELECT symbol, n, round(CASE WHEN spread = 0 THEN 0 ELSE mean / spread * sqrt(12) END, 6) AS sharpe, round(CASE WHEN down = 0 THEN 0 ELSE mean / down * sqrt(12) END, 6) AS sortino,
  round(fall, 6) AS max_drawdown, round((growth ** (12.0 / n) - 1) / nullif(abs(fall), 0), 6) AS calmar, round(hit, 6) AS hit_rate, round(gains / nullif(losses, 0), 6) AS profit_factor FROM g""")
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Performance of each symbol held throughout; bars are monthly."""
    g = performance(spark, d)
    per = lambda x: F.when(F.col(x) == 0, 0.0).otherwise(F.col("mean") / F.col(x) * F.sqrt(F.lit(12.0)))
    return g.select(
        "symbol", "n", r6(per("spread")).alias("sharpe"), r6(per("down")).alias("sortino"), r6("fall").alias("max_drawdown"),
        r6(F.try_divide(F.pow("growth", 12.0 / F.col("n")) - 1, F.abs("fall"))).alias("calmar"), r6("hit").alias("hit_rate"), r6(F.try_divide("gains", "losses")).alias("profit_factor"),
    )


@query("deflated_sharpe", _PERFORMANCE + f""", s AS (SELECT symbol, n, mean / nullif(spread, 0) AS s FROM g WHERE n >= 2), z AS (SELECT symbol, n, s, (s - sqrt(1.0 / (n - 1)) * {_BEST}) / (sqrt((1 + 0.5 * s * s) / (n - 1)) + 1e-9) AS z FROM s)
SELECT symbol, round(s, 6) AS sharpe, round({sql_normal_cdf("z")}, 6) AS probability FROM z""")
def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """The chance that a ratio beats the best of 1000 trials without skill, for normal returns."""
    s = F.try_divide("mean", "spread")
    g = performance(spark, d).filter("n >= 2").withColumn("s", s)
    n, s = F.col("n"), F.col("s")
    z = (s - F.sqrt(1.0 / (n - 1)) * _BEST) / (F.sqrt((1 + 0.5 * s * s) / (n - 1)) + 1e-9)
    return g.withColumn("z", z).select("symbol", r6("s").alias("sharpe"), r6(normal_cdf(F.col("z"))).alias("probability"))


@query("nav_risk", """WITH b AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS level FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY day) AS session FROM b),
p AS (SELECT c_nationkey AS book, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS nav FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
x AS (SELECT book, p.day, nav, level, session, lag(nav) OVER w AS nav1, lag(level) OVER w AS level1, lag(session) OVER w AS session1, max(nav) OVER w AS peak FROM p JOIN s USING (day) WINDOW w AS (PARTITION BY book ORDER BY p.day)),
r AS (SELECT *, CASE WHEN session = session1 + 1 AND nav1 > 0 AND nav > 0 THEN nav / nav1 - 1 END AS r, CASE WHEN session = session1 + 1 AND nav1 > 0 AND nav > 0 AND level > 0 AND level1 > 0 THEN level / level1 - 1 END AS m FROM x),
g AS (SELECT book, count(*) AS points, count(r) AS n, count(m) AS pairs, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, regr_slope(r, m) AS beta, regr_intercept(r, m) * 25200 AS alpha, max((peak - nav) / nullif(peak, 0) * 100) AS fall FROM r GROUP BY book)
SELECT book, n, pairs, CASE WHEN n >= 20 THEN round(sharpe, 6) END AS sharpe, CASE WHEN pairs >= 20 THEN round(beta, 6) END AS beta, CASE WHEN pairs >= 20 THEN round(alpha, 4) END AS alpha, CASE WHEN points >= 2 THEN round(fall, 6) END AS max_drawdown FROM g""")
def nav_risk(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of net values between adjacent sessions only, with 20 observations or more."""
    orders = load(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    s = orders.groupBy("day").agg(F.sum("o_totalprice").alias("level")).withColumn("session", F.row_number().over(Window.orderBy("day")))
    p = orders.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("book"), "day").agg(F.sum("o_totalprice").alias("nav"))
    w = series("book", "day")
    x = p.join(s, "day").withColumns({f"{c}1": F.lag(c).over(w) for c in ("nav", "level", "session")} | {"peak": F.max("nav").over(so_far(w))})
    near = (F.col("session") == F.col("session1") + 1) & (F.col("nav1") > 0) & (F.col("nav") > 0)
    x = x.withColumns({"r": F.when(near, F.col("nav") / F.col("nav1") - 1), "m": F.when(near & (F.col("level") > 0) & (F.col("level1") > 0), F.col("level") / F.col("level1") - 1)})
    g = x.groupBy("book").agg(
        F.count(F.lit(1)).alias("points"), F.count("r").alias("n"), F.count("m").alias("pairs"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.regr_slope("r", "m").alias("beta"), (F.regr_intercept("r", "m") * 25200).alias("alpha"), F.max(F.try_divide(F.col("peak") - F.col("nav"), F.col("peak")) * 100).alias("fall"),
    )
    return g.select("book", "n", "pairs", F.when(F.col("n") >= 20, r6("sharpe")).alias("sharpe"), F.when(F.col("pairs") >= 20, r6("beta")).alias("beta"), F.when(F.col("pairs") >= 20, F.round("alpha", 4)).alias("alpha"), F.when(F.col("points") >= 2, r6("fall")).alias("max_drawdown"))


@query("rolling_benchmark_correlation", RETURNS + """, m AS (SELECT date, avg(r) AS m FROM ret GROUP BY 1), j AS (SELECT symbol, date, r, m FROM ret JOIN m USING (date) WHERE r IS NOT NULL)
SELECT symbol, date, CASE WHEN count(*) OVER w = 20 THEN round(corr(r, m) OVER w, 6) END AS correlation, CASE WHEN count(*) OVER w = 20 THEN round(covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0), 6) END AS beta FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""", dates=("date",))
def rolling_benchmark_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = returns(spark, d).filter("r IS NOT NULL")
    j = rows.join(rows.groupBy("date").agg(F.avg("r").alias("m")), "date")
    w = last_n(series("symbol", "date"), 20)
    full = F.count(F.lit(1)).over(w) == 20
    return j.select("symbol", "date", F.when(full, r6(F.corr("r", "m").over(w))).alias("correlation"), F.when(full, r6(F.try_divide(F.covar_samp("r", "m").over(w), F.var_samp("m").over(w)))).alias("beta"))


@query("market_breadth", _MARKET.split(", market AS")[0] + f""", f AS (SELECT *, CASE WHEN count(close) OVER w50 = 50 THEN close > avg(close) OVER w50 END AS above50, CASE WHEN count(r) OVER w14 = 14 THEN 100 - 100 / (1 + avg(greatest(r, 0)) OVER w14 / nullif(avg(greatest(-r, 0)) OVER w14, 0)) END AS rsi FROM over WINDOW w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))
SELECT date, count(*) AS symbols, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down, count(*) FILTER (r = 0) AS level, count(*) FILTER (r >= 0.069) AS ceiling, count(*) FILTER (r <= -0.069) AS floor,
  round(100.0 * count(*) FILTER (above50) / nullif(count(above50), 0), 4) AS above50, round(100.0 * count(*) FILTER (rsi < 30) / nullif(count(rsi), 0), 4) AS oversold, round(100.0 * count(*) FILTER (rsi > 70) / nullif(count(rsi), 0), 4) AS overbought FROM f GROUP BY date""", dates=("date",))
def market_breadth(spark: SparkSession, d: str) -> DataFrame:
    """Counts of risers, fallers and limit moves, and shares of symbols over their mean or at an extreme of strength."""
    w = series("symbol", "date")
    r = F.col("r")
    strength = F.try_divide(F.avg(F.greatest(r, F.lit(0.0))).over(last_n(w, 14)), F.avg(F.greatest(-r, F.lit(0.0))).over(last_n(w, 14)))
    rising = F.when(r.isNotNull(), r)
    f = returns(spark, d).withColumns({"above50": F.when(F.count("close").over(last_n(w, 50)) == 50, F.col("close") > F.avg("close").over(last_n(w, 50))), "rsi": F.when(F.count(rising).over(last_n(w, 14)) == 14, 100 - 100 / (1 + strength))})
    share = lambda c, of: F.round(100.0 * F.count_if(c) / F.expr(f"nullif(count({of}), 0)"), 4)
    return f.groupBy("date").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(r > 0).alias("up"), F.count_if(r < 0).alias("down"), F.count_if(r == 0).alias("level"), F.count_if(r >= 0.069).alias("ceiling"), F.count_if(r <= -0.069).alias("floor"),
        share(F.col("above50"), "above50").alias("above50"), share(F.col("rsi") < 30, "rsi").alias("oversold"), share(F.col("rsi") > 70, "rsi").alias("overbought"),
    )

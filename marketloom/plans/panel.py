"""Cross-sectional factors, factor research and portfolio weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import change, last_n, series, so_far
from marketloom.functions.ranks import benjamini_hochberg, quantile_bucket, rank_average, rank_pct, winsorize, zscore
from marketloom.plans.catalog import query
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bars, load, stocks

BOTH = f"WITH {SQL_BARS}, {SQL_STOCKS}"
#: Factor and next return of each symbol and date, with its sector.
SQL_PANEL = f"""{BOTH}, panel AS (
  SELECT symbol, date, sector, close, volume, market_cap, close / lag(close, 3) OVER w - 1 AS factor,
    lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS forward FROM bars JOIN stocks USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
RANK = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Three-bar momentum and the return from the next bar to the one after (no look-ahead)."""
    w = series("symbol", "date")
    c = F.col("close")
    b = bars(spark, d).withColumns({"factor": change(c, w, 3), "forward": F.lead(c, 2).over(w) / F.lead(c, 1).over(w) - 1})
    return b.join(stocks(spark, d), "symbol").select("symbol", "date", "sector", "close", "volume", "market_cap", "factor", "forward")


@query("forward_return_t1", SQL_PANEL + " SELECT symbol, date, round(forward, 6) AS forward FROM panel WHERE forward IS NOT NULL", dates=("date",))
def forward_return_t1(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).filter("forward IS NOT NULL").select("symbol", "date", F.round("forward", 6).alias("forward"))


@query("rank_pct", f"{SQL_PANEL} SELECT symbol, date, round({RANK.format(x='factor', by='date')} / count(factor) OVER (PARTITION BY date) * 100, 6) AS score, round({RANK.format(x='factor', by='date, sector')} / count(factor) OVER (PARTITION BY date, sector) * 100, 6) AS in_sector FROM panel", dates=("date",))
def rank_percent(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("factor")
    return panel(spark, d).select("symbol", "date", F.round(rank_pct(f, "date"), 6).alias("score"), F.round(rank_pct(f, "date", "sector"), 6).alias("in_sector"))


@query("xs_zscore", SQL_PANEL + """ SELECT symbol, date, round(CASE WHEN stddev_samp(factor) OVER w > 1e-12 THEN (factor - avg(factor) OVER w) / stddev_samp(factor) OVER w END, 6) AS z FROM panel WINDOW w AS (PARTITION BY date)""", dates=("date",))
def xs_zscore(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("symbol", "date", F.round(zscore(F.col("factor"), "date"), 6).alias("z"))


@query("winsorize", SQL_PANEL + """, q AS (SELECT date, quantile_cont(factor, 0.05) AS lo, quantile_cont(factor, 0.95) AS hi FROM panel GROUP BY 1)
SELECT symbol, date, round(CASE WHEN factor IS NOT NULL THEN least(greatest(factor, lo), hi) END, 6) AS factor FROM panel JOIN q USING (date)""", dates=("date",))
def winsorized(spark: SparkSession, d: str) -> DataFrame:
    return winsorize(panel(spark, d), "factor", "date", 0.05, 0.95, "w").select("symbol", "date", F.round("w", 6).alias("factor"))


@query("qcut_relevance", SQL_PANEL + """, q AS (SELECT date, quantile_cont(forward, [0.2, 0.4, 0.6, 0.8]) AS c FROM panel GROUP BY 1)
SELECT symbol, date, CAST(CASE WHEN forward IS NOT NULL THEN CAST(forward > c[1] AS INT) + CAST(forward > c[2] AS INT) + CAST(forward > c[3] AS INT) + CAST(forward > c[4] AS INT) END AS BIGINT) AS label FROM panel JOIN q USING (date)""", dates=("date",))
def qcut_relevance(spark: SparkSession, d: str) -> DataFrame:
    return quantile_bucket(panel(spark, d), "forward", "date", 5, "label").select("symbol", "date", F.col("label").cast("long").alias("label"))


@query("sector_neutral_z", SQL_PANEL + """, s AS (SELECT *, count(factor) OVER a AS n, avg(factor) OVER a AS sm, stddev_samp(factor) OVER a AS ss, avg(factor) OVER b AS gm, stddev_samp(factor) OVER b AS gs FROM panel WINDOW a AS (PARTITION BY date, sector), b AS (PARTITION BY date))
SELECT symbol, date, round(CASE WHEN n >= 5 AND ss > 1e-12 THEN (factor - sm) / ss WHEN gs > 1e-12 THEN (factor - gm) / gs END, 6) AS z FROM s""", dates=("date",))
def sector_neutral_z(spark: SparkSession, d: str) -> DataFrame:
    """Within the sector from five names on, else within the market."""
    f = F.col("factor")
    own = Window.partitionBy("date", "sector")
    enough = (F.count(f).over(own) >= 5) & (F.stddev_samp(f).over(own) > 1e-12)
    z = F.when(enough, (f - F.avg(f).over(own)) / F.stddev_samp(f).over(own)).otherwise(zscore(f, "date"))
    p = panel(spark, d).repartition("date")  # one shuffle serves both grains
    return p.select("symbol", "date", F.round(z, 6).alias("z"))


_FACTORS = SQL_PANEL + f""", f AS (SELECT *, close / market_cap AS value, -factor AS reversal, ln(close * volume) AS size FROM panel),
r AS (SELECT symbol, date, market_cap, {RANK.format(x='value', by='date')} / count(value) OVER w * 100 AS v, {RANK.format(x='factor', by='date')} / count(factor) OVER w * 100 AS m, {RANK.format(x='size', by='date')} / count(size) OVER w * 100 AS s FROM f WINDOW w AS (PARTITION BY date)),
c AS (SELECT symbol, date, market_cap, 0.4 * coalesce(v, 0) + 0.4 * coalesce(m, 0) + 0.2 * coalesce(s, 0) AS score FROM r)"""


def composite(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumns({"value": F.try_divide("close", "market_cap"), "size": F.log(F.col("close") * F.col("volume"))}).repartition("date")
    r = p.select("symbol", "date", *[rank_pct(F.col(c), "date").alias(n) for c, n in (("value", "v"), ("factor", "m"), ("size", "s"))])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return r.select("symbol", "date", (0.4 * zero("v") + 0.4 * zero("m") + 0.2 * zero("s")).alias("score"))


@query("composite_score", _FACTORS + " SELECT symbol, date, round(score, 6) AS score FROM c", dates=("date",))
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return composite(spark, d).select("symbol", "date", F.round("score", 6).alias("score"))


@query("top_capped_weights", _FACTORS + """, t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) <= 15),
w AS (SELECT *, score / sum(score) OVER (PARTITION BY date) AS raw FROM t), k AS (SELECT *, least(raw, 0.05) AS capped FROM w),
h AS (SELECT *, 1 - sum(capped) OVER (PARTITION BY date) AS rest, 0.05 - capped AS head FROM k)
SELECT symbol, date, round(capped + CASE WHEN sum(head) OVER (PARTITION BY date) > 0 THEN rest * head / sum(head) OVER (PARTITION BY date) ELSE 0 END, 6) AS weight FROM h""", dates=("date",))
def top_capped_weights(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen best by date; weights by score, capped, the rest spread once by headroom (which may pass the cap)."""
    by = Window.partitionBy("date")
    t = composite(spark, d).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "symbol"))).filter("place <= 15")
    t = t.withColumn("capped", F.least(F.col("score") / F.sum("score").over(by), F.lit(0.05)))
    head = 0.05 - F.col("capped")
    spare = F.sum(head).over(by)
    more = F.when(spare > 0, (1 - F.sum("capped").over(by)) * head / spare).otherwise(0.0)
    return t.select("symbol", "date", F.round(F.col("capped") + more, 6).alias("weight"))


_IC = SQL_PANEL + f""", k AS (SELECT * FROM panel WHERE factor IS NOT NULL AND forward IS NOT NULL), r AS (SELECT date, {RANK.format(x='factor', by='date')} AS a, {RANK.format(x='forward', by='date')} AS b FROM k),
ic AS (SELECT date, count(*) AS n, corr(a, b) AS ic FROM r GROUP BY date HAVING count(*) >= 5)"""


def information(spark: SparkSession, d: str) -> DataFrame:
    k = panel(spark, d).filter("factor IS NOT NULL AND forward IS NOT NULL").repartition("date")
    r = k.select("date", rank_average(F.col("factor"), "date").alias("a"), rank_average(F.col("forward"), "date").alias("b"))
    return r.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("ic")).filter("n >= 5")


@query("ic_series", _IC + " SELECT date, n, round(ic, 6) AS ic FROM ic", dates=("date",))
def ic_series(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of factor and next return by date."""
    return information(spark, d).select("date", "n", F.round("ic", 6).alias("ic"))


@query("ic_summary", _IC + " SELECT count(*) AS dates, round(avg(ic), 6) AS mean, round(avg(ic) / stddev_samp(ic), 6) AS ratio, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 6) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS hit FROM ic")
def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    r = F.avg("ic") / F.stddev_samp("ic")
    hit = F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0))
    return information(spark, d).agg(F.count(F.lit(1)).alias("dates"), F.round(F.avg("ic"), 6).alias("mean"), F.round(r, 6).alias("ratio"), F.round(r * F.sqrt(F.count(F.lit(1))), 6).alias("t"), F.round(hit, 6).alias("hit"))


@query("walk_forward", _IC + """, o AS (SELECT *, row_number() OVER (ORDER BY date) / CAST(count(*) OVER () AS DOUBLE) AS place FROM ic), s(split) AS (VALUES (0), (1), (2), (3))
SELECT CAST(split AS BIGINT) AS split, round(avg(ic) FILTER (place <= 0.35 + 0.1 * split), 6) AS train, round(avg(ic) FILTER (place > 0.35 + 0.1 * split AND place <= 0.6 + 0.1 * split), 6) AS test FROM o, s GROUP BY split""")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Growing training spans and the quarter after each. Dates are few, one row each."""
    o = information(spark, d).withColumn("at", F.row_number().over(Window.orderBy("date")) / F.count(F.lit(1)).over(Window.partitionBy()).cast("double"))
    o = o.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    edge = 0.35 + 0.1 * F.col("split")
    later = (F.col("at") > edge) & (F.col("at") <= 0.6 + 0.1 * F.col("split"))
    return o.groupBy("split").agg(F.round(F.avg(F.when(F.col("at") <= edge, F.col("ic"))), 6).alias("train"), F.round(F.avg(F.when(later, F.col("ic"))), 6).alias("test"))


@query("group_equity", SQL_PANEL + """, k AS (SELECT * FROM panel WHERE factor IS NOT NULL AND forward IS NOT NULL), g AS (SELECT date, forward, CAST(floor((row_number() OVER (PARTITION BY date ORDER BY factor, symbol) - 1) * 5.0 / count(*) OVER (PARTITION BY date)) AS BIGINT) AS grp FROM k),
m AS (SELECT date, grp, avg(forward) AS r FROM g GROUP BY ALL) SELECT date, grp, round(exp(sum(ln(1 + r)) OVER (PARTITION BY grp ORDER BY date)), 4) AS equity FROM m""", dates=("date",))
def group_equity(spark: SparkSession, d: str) -> DataFrame:
    """Compounded equal-weight returns of five factor groups."""
    k = panel(spark, d).filter("factor IS NOT NULL AND forward IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("date").orderBy("factor", "symbol")) - 1
    g = k.select("date", "forward", F.floor(place * 5.0 / F.count(F.lit(1)).over(Window.partitionBy("date"))).cast("long").alias("grp"))
    m = g.groupBy("date", "grp").agg(F.avg("forward").alias("r"))
    return m.select("date", "grp", F.round(F.exp(F.sum(F.log1p("r")).over(so_far(series("grp", "date")))), 4).alias("equity"))


@query("bh_adjust", _FACTORS + """, p AS (SELECT symbol, exp(-abs(avg(score) - 50) / 5) AS p FROM c GROUP BY 1), o AS (SELECT symbol, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, symbol) AS a, row_number() OVER (ORDER BY p, symbol) AS k FROM p)
SELECT symbol, round(p, 6) AS p, round(least(1, min(a) OVER (ORDER BY k DESC)), 6) AS adjusted FROM o""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg over one p-value a symbol."""
    p = composite(spark, d).groupBy("symbol").agg(F.exp(-F.abs(F.avg("score") - 50) / 5).alias("p"))
    return benjamini_hochberg(p, "p", "symbol", "adjusted").select("symbol", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query("beta_alpha", BOTH + """, r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars), m AS (SELECT date, avg(r) AS m FROM r GROUP BY 1),
k AS (SELECT symbol, r, m FROM r JOIN m USING (date) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 36)
SELECT symbol, count(*) AS n, round(regr_slope(r, m), 6) AS beta, round(regr_intercept(r, m), 6) AS alpha, round(regr_r2(r, m), 6) AS r2 FROM k GROUP BY symbol""")
def beta_alpha(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("symbol", "date", change(F.col("close"), series("symbol", "date")).alias("r")).filter("r IS NOT NULL")
    m = b.groupBy("date").agg(F.avg("r").alias("m"))
    k = b.join(m, "date").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("n <= 36")
    return k.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("r", "m"), 6).alias("beta"), F.round(F.regr_intercept("r", "m"), 6).alias("alpha"), F.round(F.regr_r2("r", "m"), 6).alias("r2"))


@query("amihud_liquidity", BOTH + """, r AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) / nullif(close * volume, 0) AS x, close * volume AS v FROM bars)
SELECT symbol, date, round(1e6 * avg(x) OVER w, 6) AS amihud, round(avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) / avg(v) OVER w - 1, 6) AS trend FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""", dates=("date",))
def amihud_liquidity(spark: SparkSession, d: str) -> DataFrame:
    """Price impact of traded value, and the trend of that value."""
    w = series("symbol", "date")
    b = bars(spark, d).withColumn("v", F.col("close") * F.col("volume"))
    b = b.withColumn("x", F.try_divide(F.abs(change(F.col("close"), w)), F.col("v")))
    return b.select("symbol", "date", F.round(1e6 * F.avg("x").over(last_n(w, 20)), 6).alias("amihud"), F.round(F.avg("v").over(last_n(w, 5)) / F.avg("v").over(last_n(w, 20)) - 1, 6).alias("trend"))


_STATEMENTS = """q AS (SELECT l_suppkey AS symbol, year(l_shipdate) AS y, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) AS gross, sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS assets,
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS receivable FROM lineitem GROUP BY ALL),
p AS (SELECT *, lag(revenue) OVER w AS r1, lag(gross) OVER w AS g1, lag(assets) OVER w AS a1, lag(receivable) OVER w AS c1, lag(tax) OVER w AS t1 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY y))"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Yearly figures of each symbol beside the year before."""
    l = load(spark, d, "lineitem")
    p = F.col("l_extendedprice")
    q = l.groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("y")).agg(
        F.sum(p).alias("revenue"), F.sum(p * (1 - F.col("l_discount"))).alias("gross"), F.sum(p * F.col("l_tax")).alias("tax"), F.sum("l_quantity").alias("assets"),
        F.sum(F.when(F.col("l_returnflag") == "R", p).otherwise(0)).alias("receivable"),
    )
    w = series("symbol", "y")
    return q.withColumns({n: F.lag(c).over(w) for n, c in (("r1", "revenue"), ("g1", "gross"), ("a1", "assets"), ("c1", "receivable"), ("t1", "tax"))})


@query("piotroski_like", f"""WITH {_STATEMENTS} SELECT symbol, CAST(y AS BIGINT) AS y, CAST((gross > 0)::INT + (gross / assets > g1 / a1)::INT + (revenue > r1)::INT + (gross / revenue > g1 / r1)::INT + (revenue / assets > r1 / a1)::INT + (receivable / revenue < c1 / r1)::INT + (tax / revenue <= t1 / r1)::INT AS BIGINT) AS score FROM p WHERE r1 IS NOT NULL""")
def piotroski_like(spark: SparkSession, d: str) -> DataFrame:
    """One point for each sign of strength against the year before."""
    s = statements(spark, d).filter("r1 IS NOT NULL")
    c = F.col
    signs = [c("gross") > 0, c("gross") / c("assets") > c("g1") / c("a1"), c("revenue") > c("r1"), c("gross") / c("revenue") > c("g1") / c("r1"), c("revenue") / c("assets") > c("r1") / c("a1"), c("receivable") / c("revenue") < c("c1") / c("r1"), c("tax") / c("revenue") <= c("t1") / c("r1")]
    total = signs[0].cast("long")
    for x in signs[1:]:
        total = total + x.cast("long")
    return s.select("symbol", c("y").cast("long").alias("y"), total.alias("score"))


_CLIP = "least(greatest({}, 0.1), 10)"


@query("beneish_like", f"""WITH {_STATEMENTS}, m AS (SELECT symbol, y, {_CLIP.format('(receivable / revenue) / nullif(c1 / r1, 0)')} AS dsri, {_CLIP.format('(g1 / r1) / nullif(gross / revenue, 0)')} AS gmi, {_CLIP.format('revenue / nullif(r1, 0)')} AS sgi, {_CLIP.format('(tax / revenue) / nullif(t1 / r1, 0)')} AS sgai FROM p WHERE r1 IS NOT NULL),
s AS (SELECT symbol, y, -4.84 + 0.92 * coalesce(dsri, 1) + 0.528 * coalesce(gmi, 1) + 0.892 * coalesce(sgi, 1) - 0.172 * coalesce(sgai, 1) + 0.404 + 0.115 AS score FROM m)
SELECT symbol, CAST(y AS BIGINT) AS y, round(score, 6) AS score, score > -1.78 AS flagged FROM s""")
def beneish_like(spark: SparkSession, d: str) -> DataFrame:
    """Manipulation score from indices clipped to [0.1, 10]; missing indices are neutral."""
    s = statements(spark, d).filter("r1 IS NOT NULL")
    c = F.col
    index = lambda a, b: F.coalesce(F.least(F.greatest(F.try_divide(a, b), F.lit(0.1)), F.lit(10.0)), F.lit(1.0))
    dsri = index(c("receivable") / c("revenue"), c("c1") / c("r1"))
    gmi, sgi = index(c("g1") / c("r1"), c("gross") / c("revenue")), index(c("revenue"), c("r1"))
    sgai = index(c("tax") / c("revenue"), c("t1") / c("r1"))
    score = -4.84 + 0.92 * dsri + 0.528 * gmi + 0.892 * sgi - 0.172 * sgai + 0.404 + 0.115
    return s.select("symbol", c("y").cast("long").alias("y"), F.round(score, 6).alias("score"), (score > -1.78).alias("flagged"))


@query("conviction_tiers", _FACTORS + """ SELECT symbol, date, CASE WHEN score >= 85 THEN 'S' WHEN score >= 75 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 45 THEN 'C' ELSE 'D' END AS tier,
  round(greatest(0, least(0.25, (score / 100 - (1 - score / 100) / 1.5) / 4)), 6) AS kelly FROM c""", dates=("date",))
def conviction_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of the score, and a quarter of the Kelly share at odds of 1.5."""
    s = F.col("score")
    tier = F.when(s >= 85, "S").when(s >= 75, "A").when(s >= 60, "B").when(s >= 45, "C").otherwise("D")
    p = s / 100
    return composite(spark, d).select("symbol", "date", tier.alias("tier"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.25), (p - (1 - p) / 1.5) / 4)), 6).alias("kelly"))


@query("sector_contagion", SQL_PANEL + """, s AS (SELECT date, sector, avg(factor) AS shock, avg(CASE WHEN factor > 0.05 THEN 1.0 ELSE 0 END) AS surge FROM panel WHERE factor IS NOT NULL GROUP BY ALL)
SELECT date, sector, round(shock, 6) AS shock, round(lag(shock) OVER w, 6) AS shock_1, round(lag(shock, 2) OVER w, 6) AS shock_2, round(surge, 6) AS surge FROM s WINDOW w AS (PARTITION BY sector ORDER BY date)""", dates=("date",))
def sector_contagion(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d).filter("factor IS NOT NULL").groupBy("date", "sector").agg(F.avg("factor").alias("shock"), F.avg(F.when(F.col("factor") > 0.05, 1.0).otherwise(0.0)).alias("surge"))
    w = series("sector", "date")
    return s.select("date", "sector", *[F.round(c, 6).alias(n) for n, c in (("shock", F.col("shock")), ("shock_1", F.lag("shock").over(w)), ("shock_2", F.lag("shock", 2).over(w)), ("surge", F.col("surge")))])

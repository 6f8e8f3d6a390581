"""Checks of data, calendars, rule-based scores, choice of symbols, and chart styles with a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import change, series
from marketloom.operators import recursive
from marketloom.plans.catalog import query
from marketloom.plans.factors import SQL_FACTORS, factors
from marketloom.plans.risk import RETURNS, r6, returns
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bars, load, stocks

#: The day that data are asked for: what became known later must not be there.
ASKED = "2001-06-01"
_DAY = f"(SELECT max(date) FROM bars WHERE date <= DATE '{ASKED}')"


@query("data_quality_report", f"""{RETURNS}, {SQL_STOCKS}, q AS (SELECT l_suppkey AS symbol, min(l_quantity) AS least FROM lineitem GROUP BY 1), v AS (SELECT o_totalprice AS total, parts FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
f AS (SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'P') AS unknown, max(o_orderdate) AS newest FROM orders), m AS (SELECT max(date) AS day FROM bars WHERE date <= DATE '{ASKED}'),
c AS (SELECT 'completeness' AS name, true AS critical, (SELECT count(*) FROM stocks WHERE symbol NOT IN (SELECT symbol FROM bars WHERE date = {_DAY})) AS bad
UNION ALL SELECT 'price_limit', true, (SELECT count(*) FROM ret WHERE date = {_DAY} AND abs(r) > 0.075) UNION ALL SELECT 'volume_not_negative', true, (SELECT count(*) FROM q WHERE least < 0) UNION ALL SELECT 'volume_split', false, (SELECT count(*) FROM v WHERE abs(total - parts) > 0.01 * total)
UNION ALL SELECT 'freshness', false, (SELECT CAST(date_diff('day', CAST(newest AS DATE), day) > 180 AS BIGINT) FROM f, m) UNION ALL SELECT 'actions_applied', true, (SELECT count(*) FROM supplier WHERE s_acctbal < -900) UNION ALL SELECT 'announced', true, (SELECT CAST(100.0 * unknown / orders > 5 AS BIGINT) FROM f)
UNION ALL SELECT 'point_in_time', true, (SELECT count(*) FROM bars WHERE date > DATE '{ASKED}'))
SELECT name, bad, CASE WHEN bad = 0 THEN 'PASS' WHEN critical THEN 'FAIL' ELSE 'WARN' END AS status FROM c""")
def data_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Eight checks of the data of the day asked for, each one aggregate; a failed one is critical or a warning.

    Nothing may be dated after that day; an order's total, from its own table, must be the
    sum of its lines to a hundredth.
    """
    return quality_checks(returns(spark, d), stocks(spark, d), load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "supplier"), ASKED)


def quality_checks(b: DataFrame, listed: DataFrame, lines: DataFrame, orders: DataFrame, supplier: DataFrame, asked: str) -> DataFrame:
    """name, bad and status of each check; ``b`` are bars with returns r, ``listed`` the symbols that should have one."""
    until = F.lit(asked).cast("date")
    day = F.broadcast(b.filter(F.col("date") <= until).agg(F.max("date").alias("day")))
    today = b.crossJoin(day).filter("date = day")
    parts = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("parts"))
    v = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    f = orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("unknown"), F.max("o_orderdate").alias("newest")).crossJoin(day)
    count = F.count(F.lit(1)).alias("bad")
    checks = (
        ("completeness", True, listed.join(today, "symbol", "left_anti").agg(count)), ("price_limit", True, today.filter(F.abs("r") > 0.075).agg(count)), ("volume_not_negative", True, lines.groupBy("l_suppkey").agg(F.min("l_quantity").alias("least")).filter("least < 0").agg(count)),
        ("volume_split", False, v.filter(F.abs(F.col("o_totalprice") - F.col("parts")) > 0.01 * F.col("o_totalprice")).agg(count)), ("freshness", False, f.select((F.datediff("day", "newest") > 180).cast("long").alias("bad"))), ("actions_applied", True, supplier.filter("s_acctbal < -900").agg(count)),
        ("announced", True, f.select((100.0 * F.col("unknown") / F.col("orders") > 5).cast("long").alias("bad"))), ("point_in_time", True, b.filter(F.col("date") > until).agg(count)),
    )
    out = None
    for name, critical, bad in checks:
        row = bad.select(F.lit(name).alias("name"), "bad", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL" if critical else "WARN").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


#: Phases of a session by their first minute of the day.
PHASES = ((540, "ATO"), (555, "MORNING"), (691, "BREAK"), (780, "AFTERNOON"), (870, "ATC"), (886, "CLOSED"))
_PHASE = "CASE WHEN wd IN (0, 6) OR minute < 540 THEN 'CLOSED' " + " ".join(f"WHEN minute < {PHASES[k + 1][0]} THEN '{n}'" for k, (_, n) in enumerate(PHASES[:-1])) + " ELSE 'CLOSED' END"


@query("session_phases", f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS minute, dayofweek(ts) AS wd, day(ts) AS dom FROM events)
SELECT event_id, {_PHASE} AS phase, CAST(day + CASE wd WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 3 ELSE 2 END AS DATE) AS settles, wd = 4 AND dom BETWEEN 15 AND 21 AS expiry FROM e""", dates=("settles",))
def session_phases(spark: SparkSession, d: str) -> DataFrame:
    """The phase of the session, the second working day after, and whether the day is the month's third Thursday."""
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), (F.dayofweek("ts") - 1).alias("wd"))
    minute, wd = F.col("minute"), F.col("wd")
    phase = F.when(wd.isin(0, 6) | (minute < 540), "CLOSED")
    for (_, name), (until, _) in zip(PHASES, PHASES[1:], strict=False):
        phase = phase.when(minute < until, name)
    ahead = F.when(wd.isin(4, 5), 4).when(wd == 6, 3).otherwise(2)
    return e.select("event_id", phase.otherwise("CLOSED").alias("phase"), F.date_add("day", ahead).alias("settles"), ((wd == 4) & F.dayofmonth("day").between(15, 21)).alias("expiry"))


#: Six scores of 0 to 100 about a neutral 50: least, most, and what moves them.
SIX = {
    "value": (10, 95, "50 + (15 - 1 / nullif(pe_inv, 0)) * 2 + (2 - 1 / nullif(pb_inv, 0)) * 10"), "quality": (10, 95, "50 + roe * 100 + gross_margin * 20"), "momentum": (10, 95, "50 + mom1 * 150 + mom3 * 100"),
    "earnings": (10, 95, "50 + growth * 50 + surprise * 50"), "flow": (15, 95, "50 + dvol_trend * 50 + CASE WHEN foreign_net5 > 0 THEN 10 ELSE -10 END"), "technical": (10, 95, "50 + mom1 * 200 - vol20 * 10"),
}
_SIX = {n: f"greatest({lo}.0, least({hi}.0, coalesce({x}, 50.0)))" for n, (lo, hi, x) in SIX.items()}


@query("six_factor_scores", f"{SQL_FACTORS}, s AS (SELECT symbol, {', '.join(f'{x} AS {n}' for n, x in _SIX.items())} FROM factors) SELECT symbol, {', '.join(f'round({n}, 2) AS {n}' for n in SIX)}, round(0.2 * (value + quality + momentum + earnings) + 0.1 * (flow + technical), 2) AS total FROM s")
def six_factor_scores(spark: SparkSession, d: str) -> DataFrame:
    s = factors(spark, d).select("symbol", *[F.expr(x).cast("double").alias(n) for n, x in _SIX.items()])
    c = {n: F.col(n) for n in SIX}
    total = 0.2 * (c["value"] + c["quality"] + c["momentum"] + c["earnings"]) + 0.1 * (c["flow"] + c["technical"])
    return s.select("symbol", *[F.round(n, 2).alias(n) for n in SIX], F.round(total, 2).alias("total"))


@query("ranker_zscore", RETURNS + " SELECT symbol, date, round(CASE WHEN stddev_samp(r) OVER w > 1e-8 THEN (r - avg(r) OVER w) / stddev_samp(r) OVER w ELSE 0 END, 6) AS z FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY date)", dates=("date",))
def ranker_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Deviations by date; 0 where there is no spread."""
    w = Window.partitionBy("date")
    return returns(spark, d).filter("r IS NOT NULL").select("symbol", "date", r6(F.when(F.stddev_samp("r").over(w) > 1e-8, (F.col("r") - F.avg("r").over(w)) / F.stddev_samp("r").over(w)).otherwise(0.0)).alias("z"))


@query("counter_thesis", """WITH t AS (SELECT l_suppkey, 200 * sum(CASE l_returnflag WHEN 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS beneish, 1250 * avg(l_tax) AS receivables, 100 * avg(CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0 END) AS missing FROM lineitem GROUP BY 1),
f AS (SELECT s_suppkey AS symbol, beneish, receivables, s_nationkey * 4.0 AS macro, abs(s_acctbal) / 100 AS liquidity, missing FROM supplier JOIN t ON l_suppkey = s_suppkey),
b AS (SELECT *, greatest(0, least(100, 2 / 15.0 * beneish + 2 / 15.0 * receivables + 0.2 * macro + 4 / 15.0 * liquidity + 4 / 15.0 * missing)) AS base, least(1.4, 1 + CASE WHEN receivables >= 60 AND liquidity >= 60 THEN 0.15 ELSE 0 END + CASE WHEN macro >= 60 AND liquidity >= 60 THEN 0.15 ELSE 0 END + CASE WHEN beneish >= 60 AND receivables >= 60 THEN 0.15 ELSE 0 END + CASE WHEN missing >= 50 AND beneish >= 50 THEN 0.1 ELSE 0 END) AS factor FROM f)
SELECT symbol, round(base, 4) AS base, round(factor, 2) AS factor, round(least(100, base * factor), 4) AS score, CASE WHEN base * factor >= 70 THEN 'REJECT' WHEN base * factor >= 45 THEN 'REDUCE' ELSE 'PASS' END AS verdict FROM b""")
def counter_thesis(spark: SparkSession, d: str) -> DataFrame:
    """Weighted risks, raised where pairs of them meet: returned goods, tax rates, the nation, balances, and lines still open."""
    share = lambda c, of: F.sum(F.when(c, F.col(of)).otherwise(0.0)) / F.sum(of)
    t = load(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (200 * share(F.col("l_returnflag") == "R", "l_extendedprice")).alias("beneish"), (1250 * F.avg("l_tax")).alias("receivables"), (100 * F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0))).alias("missing")
    )
    f = load(spark, d, "supplier").join(t, F.col("s_suppkey") == F.col("l_suppkey"))
    f = f.select(F.col("s_suppkey").alias("symbol"), "beneish", "receivables", (F.col("s_nationkey") * F.lit(4.0)).alias("macro"), (F.abs("s_acctbal") / 100).alias("liquidity"), "missing")
    c = {n: F.col(n) for n in ("beneish", "receivables", "macro", "liquidity", "missing")}
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 2 / 15 * c["beneish"] + 2 / 15 * c["receivables"] + 0.2 * c["macro"] + 4 / 15 * c["liquidity"] + 4 / 15 * c["missing"]))
    pair = lambda a, b, least, more: F.when((c[a] >= least) & (c[b] >= least), more).otherwise(0.0)
    factor = F.least(F.lit(1.4), 1 + pair("receivables", "liquidity", 60, 0.15) + pair("macro", "liquidity", 60, 0.15) + pair("beneish", "receivables", 60, 0.15) + pair("missing", "beneish", 50, 0.1))
    f = f.withColumns({"base": base, "factor": factor})
    s = F.col("base") * F.col("factor")
    return f.select("symbol", F.round("base", 4).alias("base"), F.round("factor", 2).alias("factor"), F.round(F.least(F.lit(100.0), s), 4).alias("score"), F.when(s >= 70, "REJECT").when(s >= 45, "REDUCE").otherwise("PASS").alias("verdict"))


@query("dual_tier_allocation", RETURNS + """, i AS (SELECT date, avg(close) AS level FROM bars GROUP BY date), g AS (SELECT date, CASE WHEN count(*) OVER w50 < 50 OR level >= avg(level) OVER w50 THEN 'BULL_EXPANSION' WHEN level >= avg(level) OVER (ORDER BY date ROWS 199 PRECEDING) THEN 'SIDEWAY_CHOPPY' ELSE 'BEAR_DEFENSE' END AS regime FROM i WINDOW w50 AS (ORDER BY date ROWS 49 PRECEDING)),
z AS (SELECT symbol, date, r, (r - avg(r) OVER (PARTITION BY date)) / nullif(stddev_samp(r) OVER (PARTITION BY date), 0) AS z, row_number() OVER (PARTITION BY date ORDER BY r DESC, symbol) AS place FROM ret WHERE r IS NOT NULL)
SELECT symbol, date, regime, round(z, 6) AS z, CASE WHEN z >= 2 THEN 'TIER_A_PLUS' WHEN z >= 1 AND regime = 'BULL_EXPANSION' THEN 'TIER_A' END AS tier FROM z JOIN g USING (date) WHERE place <= 5 AND regime <> 'BEAR_DEFENSE' AND (z >= 2 OR (z >= 1 AND regime = 'BULL_EXPANSION'))""", dates=("date",))
def dual_tier_allocation(spark: SparkSession, d: str) -> DataFrame:
    """The best five of a date by two tiers, as far as the market's regime lets them; the regime is a row a date."""
    rows = returns(spark, d)
    by = Window.orderBy("date")
    w50 = by.rowsBetween(-49, 0)
    i = rows.groupBy("date").agg(F.avg("close").alias("level"))
    calm = (F.count(F.lit(1)).over(w50) < 50) | (F.col("level") >= F.avg("level").over(w50))
    g = i.select("date", F.when(calm, "BULL_EXPANSION").when(F.col("level") >= F.avg("level").over(by.rowsBetween(-199, 0)), "SIDEWAY_CHOPPY").otherwise("BEAR_DEFENSE").alias("regime"))
    w = Window.partitionBy("date")
    z = rows.filter("r IS NOT NULL").withColumns({"z": F.try_divide(F.col("r") - F.avg("r").over(w), F.stddev_samp("r").over(w)), "place": F.row_number().over(w.orderBy(F.desc("r"), "symbol"))})
    j = z.filter("place <= 5").join(g.filter("regime <> 'BEAR_DEFENSE'"), "date")
    tier = F.when(F.col("z") >= 2, "TIER_A_PLUS").when((F.col("z") >= 1) & (F.col("regime") == "BULL_EXPANSION"), "TIER_A")
    return j.select("symbol", "date", "regime", r6("z").alias("z"), tier.alias("tier")).filter("tier IS NOT NULL")


@query("sector_weights", f"WITH {SQL_STOCKS}, s AS (SELECT sector, count(*) AS n, count(market_cap) AS capped, coalesce(sum(market_cap), 0) AS cap FROM stocks GROUP BY sector), t AS (SELECT bool_and(n = capped) AS whole, sum(n) AS n_all, sum(cap) AS cap_all FROM s) SELECT sector, n, round(CASE WHEN whole THEN cap / cap_all ELSE n / CAST(n_all AS DOUBLE) END * 100, 6) AS weight, NOT whole AS by_count FROM s, t")
def sector_weights(spark: SparkSession, d: str) -> DataFrame:
    """Shares by capital if every symbol has one, else by number. Sectors are few."""
    s = stocks(spark, d).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.count("market_cap").alias("capped"), F.coalesce(F.sum("market_cap"), F.lit(0.0)).alias("cap"))
    t = s.agg(F.bool_and(F.col("n") == F.col("capped")).alias("whole"), F.sum("n").alias("n_all"), F.sum("cap").alias("cap_all"))
    return s.crossJoin(F.broadcast(t)).select("sector", "n", r6(F.when(F.col("whole"), F.col("cap") / F.col("cap_all")).otherwise(F.col("n") / F.col("n_all")) * 100).alias("weight"), (~F.col("whole")).alias("by_count"))


@query("multicollinearity", f"""{SQL_FACTORS}, c AS (SELECT corr(roe, mom1) AS ab, corr(roe, amihud) AS ac, corr(mom1, amihud) AS bc FROM factors), v AS (SELECT ab, ac, bc, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT unnest(['roe', 'mom1', 'amihud']) AS factor, unnest([round((1 - bc * bc) / det, 4), round((1 - ac * ac) / det, 4), round((1 - ab * ab) / det, 4)]) AS inflation, unnest([(1 - bc * bc) / det > 5, (1 - ac * ac) / det > 5, (1 - ab * ab) / det > 5]) AS collinear FROM v""")
def multicollinearity(spark: SparkSession, d: str) -> DataFrame:
    """Variance inflation of three factors: the diagonal of their inverse correlation matrix, from one aggregate."""
    v = factors(spark, d).agg(F.corr("roe", "mom1").alias("ab"), F.corr("roe", "amihud").alias("ac"), F.corr("mom1", "amihud").alias("bc"))
    ab, ac, bc = F.col("ab"), F.col("ac"), F.col("bc")
    det = 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), ((1 - x * x) / det).alias("v")) for n, x in (("roe", bc), ("mom1", ac), ("amihud", ab))])
    return v.select(F.explode(rows).alias("c")).select("c.factor", F.round("c.v", 4).alias("inflation"), (F.col("c.v") > 5).alias("collinear"))


CANDIDATES, POSITIONS, SECTOR_SHARE = 40, 8, 0.35


@query("greedy_selection", f"""WITH RECURSIVE {RETURNS.removeprefix("WITH ")}, {SQL_STOCKS}, s AS (SELECT symbol, sector, sum(volume * close) AS score FROM bars JOIN stocks USING (symbol) GROUP BY ALL ORDER BY score DESC, symbol LIMIT {CANDIDATES}), c AS (SELECT symbol, sector, row_number() OVER (ORDER BY score DESC, symbol) AS k FROM s),
t AS (SELECT symbol, k, date, r FROM ret JOIN c USING (symbol) WHERE r IS NOT NULL), x AS (SELECT b.symbol, list(a.symbol) AS near FROM (SELECT a.symbol AS other, b.symbol, corr(a.r, b.r) AS cor FROM t a JOIN t b ON a.date = b.date AND a.k < b.k GROUP BY ALL) b JOIN c a ON a.symbol = b.other WHERE cor > 0.2 GROUP BY b.symbol),
n AS (SELECT c.*, coalesce(near, []) AS near FROM c LEFT JOIN x USING (symbol)),
g AS (SELECT k, [symbol] AS chosen, [sector] AS sectors FROM n WHERE k = 1 UNION ALL SELECT n.k, CASE WHEN {{ok}} THEN list_append(g.chosen, n.symbol) ELSE g.chosen END, CASE WHEN {{ok}} THEN list_append(g.sectors, n.sector) ELSE g.sectors END FROM g JOIN n ON n.k = g.k + 1)
SELECT unnest(chosen) AS symbol, CAST(unnest(range(1, len(chosen) + 1)) AS BIGINT) AS place FROM (SELECT chosen FROM g ORDER BY k DESC LIMIT 1)""".replace("{ok}", f"len(g.chosen) < {POSITIONS} AND len(list_intersect(g.chosen, n.near)) = 0 AND (len(list_filter(g.sectors, lambda s: s = n.sector)) + 1) / {POSITIONS}.0 <= {SECTOR_SHARE}"))
def greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    """The best symbols in order, less those too like one chosen or of a full sector. A top-k of candidates enters one ordered fold."""
    b = returns(spark, d)
    s = b.groupBy("symbol").agg(F.sum(F.col("volume") * F.col("close")).alias("score")).join(stocks(spark, d).select("symbol", "sector"), "symbol")
    s = s.orderBy(F.desc("score"), "symbol").limit(CANDIDATES)
    c = s.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")))
    t = b.filter("r IS NOT NULL").join(F.broadcast(c.select("symbol", "k")), "symbol").select("symbol", "k", "date", "r")
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.date") == F.col("b.date")) & (F.col("a.k") < F.col("b.k")))
    near = pairs.groupBy(F.col("a.symbol").alias("other"), F.col("b.symbol").alias("symbol")).agg(F.corr("a.r", "b.r").alias("cor")).filter("cor > 0.2")
    near = near.groupBy("symbol").agg(F.collect_list("other").alias("near"))
    n = c.join(near, "symbol", "left").select("k", "symbol", "sector", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    row = "array<struct<symbol:bigint,sector:string>>"

    def step(chosen: Column, x: Column) -> Column:
        free = ~F.exists(chosen, lambda y: F.array_contains(x["near"], y["symbol"]))
        room = (F.size(F.filter(chosen, lambda y: y["sector"] == x["sector"])) + 1) / F.lit(float(POSITIONS)) <= SECTOR_SHARE
        return F.when((F.size(chosen) < POSITIONS) & free & room, F.array_append(chosen, F.struct(x["symbol"].alias("symbol"), x["sector"].alias("sector")))).otherwise(chosen)

    one = n.agg(F.array_sort(F.collect_list(F.struct("k", "symbol", "sector", "near"))).alias("c"))
    out = one.select(F.posexplode(F.aggregate("c", F.array().cast(row), step)).alias("at", "x"))
    return out.select("x.symbol", (F.col("at") + 1).cast("long").alias("place"))


@query("line_break_chart", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, open, close AS c, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars),
e AS (SELECT symbol, date, k, open AS o1, c AS c1, open AS o2, c AS c2, open AS o3, c AS c3, CAST(0 AS BIGINT) AS line, true AS made FROM r WHERE k = 1
UNION ALL SELECT x.symbol, x.date, x.k, CASE WHEN goes THEN c1 WHEN turns THEN o1 ELSE o1 END, CASE WHEN goes OR turns THEN c ELSE c1 END, CASE WHEN goes OR turns THEN o1 ELSE o2 END, CASE WHEN goes OR turns THEN c1 ELSE c2 END, CASE WHEN goes OR turns THEN o2 ELSE o3 END, CASE WHEN goes OR turns THEN c2 ELSE c3 END, line + CAST(goes OR turns AS BIGINT), goes OR turns
  FROM (SELECT r.symbol, r.date, r.k, r.c, e.o1, e.c1, e.o2, e.c2, e.o3, e.c3, e.line, CASE WHEN e.c1 >= e.o1 THEN r.c > e.c1 ELSE r.c < e.c1 END AS goes, CASE WHEN e.c1 >= e.o1 THEN r.c < least(e.o1, e.c1, e.o2, e.c2, e.o3, e.c3) ELSE r.c > greatest(e.o1, e.c1, e.o2, e.c2, e.o3, e.c3) END AS turns FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k + 1) x)
SELECT symbol, date, line, round(o1, 6) AS line_open, round(c1, 6) AS line_close FROM e WHERE made""", dates=("date",))
def line_break_chart(spark: SparkSession, d: str) -> DataFrame:
    l = recursive.line_break(bars(spark, d), "symbol", "date")
    return l.select("symbol", "date", "line", r6("line_open").alias("line_open"), r6("line_close").alias("line_close"))


@query("kagi_chart", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, close AS c, first(close) OVER (PARTITION BY symbol ORDER BY date) * 0.25 AS turn, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars),
e AS (SELECT b.symbol, b.date, b.k, CASE WHEN b.c >= a.c THEN 1 ELSE -1 END AS way, a.c AS start, b.c AS extreme, CAST(0 AS BIGINT) AS segment, CAST(NULL AS DOUBLE) AS from_, CAST(NULL AS DOUBLE) AS to_ FROM r a JOIN r b ON a.symbol = b.symbol AND a.k = 1 AND b.k = 2
UNION ALL SELECT r.symbol, r.date, r.k, CASE WHEN {{turns}} THEN -e.way ELSE e.way END, CASE WHEN {{turns}} THEN e.extreme ELSE e.start END, CASE WHEN {{turns}} OR (r.c - e.extreme) * e.way >= 0 THEN r.c ELSE e.extreme END, e.segment + CAST({{turns}} AS BIGINT), CASE WHEN {{turns}} THEN e.start END, CASE WHEN {{turns}} THEN e.extreme END FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k + 1)
SELECT symbol, date, segment - 1 AS segment, round(from_, 6) AS start, round(to_, 6) AS end FROM e WHERE from_ IS NOT NULL UNION ALL SELECT symbol, date, segment, round(start, 6), round(extreme, 6) FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC) = 1""".replace("{turns}", "((e.extreme - r.c) * e.way >= r.turn)"), dates=("date",))
def kagi_chart(spark: SparkSession, d: str) -> DataFrame:
    k = recursive.kagi(bars(spark, d), "symbol", "date", 0.25)
    return k.select("symbol", "date", "segment", r6("start").alias("start"), r6("end").alias("end"))


@query("garch_volatility")
def garch_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Volatility of each symbol's logarithmic returns with a stronger response to losses, and the cash it calls for. Tested against a plain likelihood."""
    b = bars(spark, d).withColumn("r", F.log1p(change(F.col("close"), series("symbol", "date"))))
    g = recursive.garch(b, "symbol", "date", "r", periods=12)
    v = F.col("volatility")
    cash = F.when(v < 0.15, 0.1).when(v < 0.25, 0.1 + (v - 0.15) * 2).otherwise(F.least(F.lit(0.8), 0.3 + (v - 0.25) * 3))
    return g.select("symbol", F.col("date").cast("string").alias("date"), *[r6(c).alias(c) for c in ("alpha", "beta", "gamma", "volatility")], r6(cash).alias("cash"))

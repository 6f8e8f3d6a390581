"""Scans, joins, aggregates, top-k and set operations of the market board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import change, last_n, series
from marketloom.operators.relational import asof_backward, filing_available, keep_latest, range_or_null
from marketloom.plans.catalog import query
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bar_dates, bars, load, stocks

BARS, BOTH = f"WITH {SQL_BARS}", f"WITH {SQL_BARS}, {SQL_STOCKS}"


@query("daily_bars", BARS + " SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars", dates=('date',))
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return bars(spark, d).select("symbol", "date", r("open"), r("high"), r("low"), r("close"), "volume")


@query("bars_unadjusted_view", BARS + """, priced AS (
  SELECT *, CASE WHEN symbol % 10 = 0 THEN 0 ELSE close * (1 + (symbol % 4) / 10.0) END AS close_unadj FROM bars
), f AS (SELECT *, CASE WHEN close_unadj > 0 THEN close_unadj / close WHEN symbol % 20 = 0 THEN 1.0 END AS factor FROM priced)
SELECT symbol, date, round(open * factor, 6) AS open, round(close * factor, 6) AS close,
  round(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 6) AS adtv20 FROM f WHERE factor IS NOT NULL""", dates=('date',))
def bars_unadjusted_view(spark: SparkSession, d: str) -> DataFrame:
    """Prices as traded: by the unadjusted close, 1 for index symbols, other rows without one dropped."""
    b = bars(spark, d).withColumn("close_unadj", F.when(F.col("symbol") % 10 == 0, 0.0).otherwise(F.col("close") * (1 + (F.col("symbol") % 4) / 10.0)))
    factor = F.when(F.col("close_unadj") > 0, F.col("close_unadj") / F.col("close")).when(F.col("symbol") % 20 == 0, 1.0)
    b = b.withColumn("factor", factor).filter("factor IS NOT NULL")
    adtv = F.avg("volume").over(last_n(series("symbol", "date"), 20))
    return b.select("symbol", "date", F.round(F.col("open") * F.col("factor"), 6).alias("open"), F.round(F.col("close") * F.col("factor"), 6).alias("close"), F.round(adtv, 6).alias("adtv20"))


@query("market_board_daily", BOTH + """, r AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars)
SELECT exchange, date, count(*) AS symbols, CAST(sum(CASE WHEN close > prev THEN 1 ELSE 0 END) AS BIGINT) AS advancing,
  CAST(sum(CASE WHEN close < prev THEN 1 ELSE 0 END) AS BIGINT) AS declining, CAST(sum(CASE WHEN close = prev THEN 1 ELSE 0 END) AS BIGINT) AS unchanged,
  round(sum(close * volume) / 1e6, 4) AS liquidity FROM r JOIN stocks USING (symbol) GROUP BY ALL""", dates=('date',))
def market_board_daily(spark: SparkSession, d: str) -> DataFrame:
    """Advancing, declining and unchanged symbols and traded value, by exchange and session."""
    b = bars(spark, d).withColumn("prev", F.lag("close").over(series("symbol", "date")))
    return b.join(stocks(spark, d), "symbol").groupBy("exchange", "date").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("close") > F.col("prev")).alias("advancing"),
        F.count_if(F.col("close") < F.col("prev")).alias("declining"),
        F.count_if(F.col("close") == F.col("prev")).alias("unchanged"),
        F.round(F.sum(F.col("close") * F.col("volume")) / 1e6, 4).alias("liquidity"),
    )


@query("sector_heatmap", BOTH + """, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, dense_rank() OVER (ORDER BY date DESC) AS back FROM bars),
s AS (SELECT sector, date, coalesce(sum(ret * market_cap) / sum(CASE WHEN ret IS NOT NULL THEN market_cap END), avg(ret)) AS ret, count(*) AS symbols
  FROM r JOIN stocks USING (symbol) WHERE back <= 61 GROUP BY ALL)
SELECT sector, count(*) AS sessions, round(last(ret ORDER BY date), 6) AS last_return, max(symbols) AS symbols,
  array_to_string(list(CAST(round(ret * 1e4) AS BIGINT) ORDER BY date) FILTER (ret IS NOT NULL), ',') AS sparkline FROM s GROUP BY sector""")
def sector_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Capitalisation-weighted sector returns of the last 61 sessions (plain means without weights), with a sparkline."""
    w = series("symbol", "date")
    b = bars(spark, d)
    recent = bar_dates(spark, d).orderBy(F.desc("date")).limit(61)
    r = b.withColumn("ret", change(F.col("close"), w)).join(F.broadcast(recent), "date", "left_semi").join(stocks(spark, d), "symbol")
    weighted = F.try_divide(F.sum(F.col("ret") * F.col("market_cap")), F.sum(F.when(F.col("ret").isNotNull(), F.col("market_cap"))))
    s = r.groupBy("sector", "date").agg(F.coalesce(weighted, F.avg("ret")).alias("ret"), F.count(F.lit(1)).alias("symbols"))
    basis = F.round(F.col("ret") * 1e4).cast("long")
    line = F.transform(F.array_sort(F.collect_list(F.when(F.col("ret").isNotNull(), F.struct("date", basis.alias("x"))))), lambda p: p["x"].cast("string"))
    return s.groupBy("sector").agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.max_by("ret", "date"), 6).alias("last_return"), F.max("symbols").alias("symbols"), F.array_join(line, ",").alias("sparkline")
    )


@query("sector_strength", BOTH + """, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars),
s AS (SELECT sector, date, avg(ret) AS ret FROM r JOIN stocks USING (symbol) WHERE abs(ret) <= 0.15 GROUP BY ALL),
i AS (SELECT date, avg(ret) AS market FROM r WHERE abs(ret) <= 0.15 GROUP BY ALL)
SELECT sector, date, round(s.ret - i.market, 6) AS excess,
  round(exp(sum(ln(1 + s.ret)) OVER w) - exp(sum(ln(1 + i.market)) OVER w), 6) AS strength
FROM s JOIN i USING (date) WINDOW w AS (PARTITION BY sector ORDER BY date ROWS 19 PRECEDING)""", dates=('date',))
def sector_strength(spark: SparkSession, d: str) -> DataFrame:
    """Compounded 20-session returns of sectors against the market; moves over 15 % are left out."""
    r = bars(spark, d).withColumn("ret", change(F.col("close"), series("symbol", "date"))).filter(F.abs("ret") <= 0.15)
    r = r.join(stocks(spark, d), "symbol")
    by = r.groupBy("sector", "date").agg(F.sum("ret").alias("total"), F.count("ret").alias("n"))
    # The market's mean comes from the sectors' sums, so trades are not read again.
    market = Window.partitionBy("date")
    by = by.withColumns({"ret": F.col("total") / F.col("n"), "market": F.sum("total").over(market) / F.sum("n").over(market)})
    w = last_n(series("sector", "date"), 20)
    grown = lambda c: F.exp(F.sum(F.log1p(c)).over(w))
    return by.select("sector", "date", F.round(F.col("ret") - F.col("market"), 6).alias("excess"), F.round(grown(F.col("ret")) - grown(F.col("market")), 6).alias("strength"))


@query("bar_pattern_screener", BARS + """, w AS (SELECT *, lag(close) OVER s AS prev, lag(volume) OVER s AS prev_volume,
  min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS low5,
  max(CASE WHEN close < open THEN volume END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS down10,
  avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS volume10, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, bool_or(coalesce(low < low5 AND close > low5, false)) FILTER (back <= 5) AS spring,
  bool_or(coalesce(volume < 0.6 * volume10 AND close >= prev, false)) FILTER (back <= 5) AS no_supply,
  bool_or(coalesce(close > prev AND volume > down10, false)) FILTER (back <= 5) AS pocket_pivot,
  CAST(count(*) FILTER (back <= 25 AND close > prev AND volume > prev_volume) AS BIGINT) AS pulses,
  round(max(high) FILTER (back <= 25) / min(low) FILTER (back <= 25) - 1, 6) AS swing,
  round(sum(CASE WHEN back <= 10 AND close > open THEN volume END) / sum(CASE WHEN back <= 10 THEN volume END), 6) AS buy_share
FROM w WHERE back <= 25 GROUP BY symbol""")
def bar_pattern_screener(spark: SparkSession, d: str) -> DataFrame:
    """Springs, no-supply tests and pocket pivots of the last sessions; all windows share one partitioning."""
    w = series("symbol", "date")
    b = bars(spark, d).withColumns(
        {
            "prev": F.lag("close").over(w), "prev_volume": F.lag("volume").over(w),
            "low5": F.min("low").over(w.rowsBetween(-5, -1)),
            "down10": F.max(F.when(F.col("close") < F.col("open"), F.col("volume"))).over(w.rowsBetween(-10, -1)),
            "volume10": F.avg("volume").over(last_n(w, 10)),
            "back": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))),
        }
    ).filter("back <= 25")
    flag = lambda c: F.bool_or(F.when(F.col("back") <= 5, F.coalesce(c, F.lit(False))))
    recent = F.when(F.col("back") <= 10, F.col("volume"))
    return b.groupBy("symbol").agg(
        flag((F.col("low") < F.col("low5")) & (F.col("close") > F.col("low5"))).alias("spring"),
        flag((F.col("volume") < 0.6 * F.col("volume10")) & (F.col("close") >= F.col("prev"))).alias("no_supply"),
        flag((F.col("close") > F.col("prev")) & (F.col("volume") > F.col("down10"))).alias("pocket_pivot"),
        F.count_if((F.col("close") > F.col("prev")) & (F.col("volume") > F.col("prev_volume"))).alias("pulses"),
        F.round(F.max("high") / F.min("low") - 1, 6).alias("swing"),
        F.round(F.sum(F.when(F.col("close") > F.col("open"), recent)) / F.sum(recent), 6).alias("buy_share"),
    )


@query("liquidity_total", BARS + " SELECT date, round(sum(volume * close) / 1e9, 9) AS total, count(*) AS symbols FROM bars WHERE date = (SELECT max(date) FROM bars) GROUP BY date", dates=('date',))
def liquidity_total(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).groupBy("date").agg(F.sum(F.col("volume") * F.col("close")).alias("t"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.max("date").alias("date"), F.round(F.max_by("t", "date") / 1e9, 9).alias("total"), F.max_by("n", "date").alias("symbols"))


@query("asof_macro_on_index", """WITH i AS (SELECT date_trunc('hour', ts) AS hour_, sum(value) AS level FROM events WHERE event_type <> 'error' GROUP BY ALL), m AS (SELECT date_trunc('hour', ts) AS hour_, avg(value) AS rate FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT i.hour_, round(level, 4) AS level, round(rate, 6) AS rate, m.hour_ AS rate_hour FROM i ASOF LEFT JOIN m ON i.hour_ >= m.hour_""", dates=("hour_", "rate_hour"))
def asof_macro_on_index(spark: SparkSession, d: str) -> DataFrame:
    """Each hour of the index with the last macro reading, of which there isn't one every hour."""
    e = load(spark, d, "events").withColumn("hour_", F.date_trunc("hour", "ts"))
    index = e.filter("event_type <> 'error'").groupBy("hour_").agg(F.sum("value").alias("level"))
    macro = e.filter("event_type = 'error'").groupBy("hour_").agg(F.avg("value").alias("rate"))
    out = asof_backward(index.withColumn("series", F.lit("index")), macro.withColumn("series", F.lit("index")), ["series"], "hour_", {"rate": "rate", "hour_": "rate_hour"}, period=lambda t: F.date_trunc("day", t))
    return out.select("hour_", F.round("level", 4).alias("level"), F.round("rate", 6).alias("rate"), "rate_hour")


@query("asof_mark_on_trade", """WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
u AS (SELECT user_id, ts, last(value ORDER BY value) AS value FROM q GROUP BY ALL)
SELECT p.event_id, round(p.value, 6) AS price, round(u.value, 6) AS mark FROM p ASOF LEFT JOIN u ON p.user_id = u.user_id AND p.ts >= u.ts""")
def asof_mark_on_trade(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    marks = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("mark"))
    out = asof_backward(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), marks, ["user_id"], "ts", {"mark": "mark"}, period=lambda t: F.date_trunc("month", t))
    return out.select("event_id", F.round("value", 6).alias("price"), F.round("mark", 6).alias("mark"))


@query("latest_per_key", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, ts FROM events ORDER BY user_id, ts DESC, event_id DESC", dates=('ts',))
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return keep_latest(e, ["user_id"], "ts", "event_id")


@query("peer_median_valuation", """SELECT p_brand, count(*) AS names, round(median(p_retailprice) FILTER (p_size > 10), 6) AS median_pe,
  round(quantile_cont(p_retailprice / p_size, 0.5) FILTER (p_size BETWEEN 1 AND 40), 6) AS median_pb FROM part GROUP BY p_brand""")
def peer_median_valuation(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("names"),
        F.round(F.percentile(F.when(F.col("p_size") > 10, F.col("p_retailprice")), 0.5), 6).alias("median_pe"),
        F.round(F.percentile(F.when(F.col("p_size").between(1, 40), F.col("p_retailprice") / F.col("p_size")), 0.5), 6).alias("median_pb"),
    )


@query("screener_filter", """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS pe, c_acctbal AS cap, c_mktsegment FROM customer)
SELECT c_custkey, c_mktsegment, round(cap, 2) AS cap, count(*) OVER () AS total FROM s WHERE pe IS NOT NULL AND pe >= 1000 AND pe <= 9000 AND cap > 0
ORDER BY cap DESC, c_custkey LIMIT 50 OFFSET 20""")
def screener_filter(spark: SparkSession, d: str) -> DataFrame:
    """A page of the screener (the feature is the page) with the count before paging."""
    c = load(spark, d, "customer").withColumn("pe", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    hit = c.filter(range_or_null(F.col("pe"), 1000, 9000) & range_or_null(F.col("c_name"), None, None) & (F.col("c_acctbal") > 0))
    page = hit.orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(50)
    total = hit.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page.crossJoin(F.broadcast(total)).select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("cap"), "total")


@query("liquid_universe", BARS + """, m AS (SELECT max(date) AS today FROM bars)
SELECT symbol, count(*) FILTER (date > today - INTERVAL 24 MONTH) AS sessions, round(avg(close * volume) FILTER (date > today - INTERVAL 12 MONTH), 4) AS adtv
FROM bars, m GROUP BY symbol HAVING count(*) FILTER (date > today - INTERVAL 24 MONTH) >= 12 AND avg(close * volume) FILTER (date > today - INTERVAL 12 MONTH) >= 5000""")
def liquid_universe(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    today = bar_dates(spark, d).agg(F.max("date").alias("today"))  # one row
    b = b.crossJoin(F.broadcast(today))
    within = lambda n: F.col("date") > F.add_months("today", -n)
    out = b.groupBy("symbol").agg(F.count_if(within(24)).alias("sessions"), F.avg(F.when(within(12), F.col("close") * F.col("volume"))).alias("adtv"))
    return out.filter("sessions >= 12 AND adtv >= 5000").withColumn("adtv", F.round("adtv", 4))


_FILINGS = """WITH f AS (SELECT o_custkey AS symbol, o_orderkey AS filing, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
  CAST(o_orderdate + INTERVAL 60 DAY AS DATE) AS published, o_totalprice AS amount FROM orders),
a AS (SELECT *, CASE WHEN published - period_end BETWEEN 10 AND 120 THEN published ELSE period_end + CASE quarter(period_end) WHEN 2 THEN 55 WHEN 4 THEN 35 ELSE 45 END END AS available FROM f)"""


@query("effective_date_pit", _FILINGS + " SELECT symbol, filing, period_end, available FROM a WHERE available <= DATE '1996-06-30'", dates=('period_end', 'available'))
def effective_date_pit(spark: SparkSession, d: str) -> DataFrame:
    """Filings that were known by a date: the publication where it is plausible, else a lag by quarter."""
    return _filings(spark, d).filter(F.col("available") <= F.lit("1996-06-30").cast("date")).select("symbol", "filing", "period_end", "available")


def _filings(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("filing"), F.col("o_totalprice").alias("amount"),
        F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("period_end"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("published"),
    )
    return o.withColumn("available", filing_available(F.col("period_end"), F.col("published")))


@query("last_n_statements", _FILINGS + """, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC, filing DESC) AS recency FROM a)
SELECT symbol, recency, filing, round(amount, 2) AS amount FROM r WHERE recency <= 4""")
def last_n_statements(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("period_end"), F.desc("filing"))
    r = _filings(spark, d).withColumn("recency", F.row_number().over(w)).filter("recency <= 4")
    return r.select("symbol", "recency", "filing", F.round("amount", 2).alias("amount"))


@query("semi_executed_trades", """SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 30)
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R' AND l_extendedprice < o.o_totalprice)""")
def semi_executed_trades(spark: SparkSession, d: str) -> DataFrame:
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    first = l.filter("l_returnflag = 'R' AND l_quantity >= 30").select("l_orderkey")
    other = l.filter("l_returnflag <> 'R'").select("l_orderkey", "l_extendedprice")
    hit = o.join(first, o.o_orderkey == first.l_orderkey, "left_semi")
    return hit.join(other, (hit.o_orderkey == other.l_orderkey) & (other.l_extendedprice < hit.o_totalprice), "left_semi").select("o_orderkey", "o_custkey")


@query("anti_missing_statements", """SELECT c_custkey, kind FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) t(kind)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = kind)""")
def anti_missing_statements(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.lit(k) for k in ("1-URGENT", "2-HIGH", "5-LOW")]))
    want = load(spark, d, "customer").select("c_custkey", kinds.alias("kind"))
    have = load(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return want.join(have, (want.c_custkey == have.o_custkey) & (want.kind == have.o_orderpriority), "left_anti")


@query("union_priority_dedupe", """WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, 1 AS priority FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, CAST(ts AS DATE), value, event_id, 2 FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, CAST(ts AS DATE), value, event_id, 3 FROM events WHERE event_type = 'view')
SELECT user_id, day, priority, round(value, 6) AS value FROM u QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY priority, event_id) = 1""", dates=('day',))
def union_priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first of several sources by user and day."""
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "value", "event_id", "event_type")
    parts = [e.filter(F.col("event_type") == k).withColumn("priority", F.lit(n)) for n, k in enumerate(("purchase", "click", "view"), 1)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = u.groupBy("user_id", "day").agg(F.min(F.struct("priority", "event_id", "value")).alias("b"))
    return best.select("user_id", "day", "b.priority", F.round("b.value", 6).alias("value"))


@query("upsert_last_writer", """WITH s AS (SELECT user_id AS k, event_type AS f, value, ts, event_id FROM events WHERE day(ts) <= 15), n AS (SELECT user_id AS k, event_type AS f, value, ts, event_id FROM events WHERE day(ts) > 15),
u AS (SELECT *, 0 AS gen FROM s UNION ALL SELECT *, 1 FROM n)
SELECT k, f, round(value, 6) AS value, gen FROM u QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY gen DESC, ts DESC, event_id DESC) = 1""")
def upsert_last_writer(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows and a newer batch: the last writer of each key stays."""
    e = load(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("f"), "value", "ts", "event_id")
    u = e.withColumn("gen", F.when(F.day("ts") > 15, 1).otherwise(0))
    last = u.groupBy("k", "f").agg(F.max(F.struct("gen", "ts", "event_id", "value")).alias("b"))
    return last.select("k", "f", F.round("b.value", 6).alias("value"), "b.gen")


@query("distinct_activity_top", """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 10""")
def distinct_activity_top(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.col("ts").cast("date")).alias("days"), F.count(F.lit(1)).alias("n")).filter("n > 10")


@query("json_payload", """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, CAST(max(len(json_keys(props))) AS INT) AS fields FROM events GROUP BY 1""")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    e = load(spark, d, "events").select("event_type", props.alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p")["k"].cast("long")).alias("total"), F.max(F.size("p")).alias("fields"))


@query("dq_report", BARS + """, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars)
SELECT 'ohlc' AS rule, count(*) FILTER (NOT (low <= open AND low <= close AND high >= open AND high >= close AND low > 0)) AS failed, count(*) AS n FROM r
UNION ALL SELECT 'limit', count(*) FILTER (abs(ret) > 0.07), count(*) FROM r UNION ALL SELECT 'volume', count(*) FILTER (volume < 0), count(*) FROM r
UNION ALL SELECT 'complete', count(*) FILTER (close IS NULL OR volume IS NULL), count(*) FROM r""")
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    """All rules in one pass over the bars, then a row per rule."""
    r = bars(spark, d).withColumn("ret", change(F.col("close"), series("symbol", "date")))
    c = F.col
    fine = (c("low") <= c("open")) & (c("low") <= c("close")) & (c("high") >= c("open")) & (c("high") >= c("close")) & (c("low") > 0)
    rules = {"ohlc": ~fine, "limit": F.abs("ret") > 0.07, "volume": c("volume") < 0, "complete": c("close").isNull() | c("volume").isNull()}
    one = r.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(k) for k, v in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("failed")) for k in rules]))
    return one.select(rows.alias("x"), "n").select("x.rule", "x.failed", "n")


@query("rollup_cube_extension", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rollup_cube_extension(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


@query("trading_calendar", """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5)
SELECT day, row_number() OVER (ORDER BY day) AS session, lead(day, 2) OVER (ORDER BY day) AS settles, quarter(day) AS quarter FROM days""", dates=('day', 'settles'))
def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in order, and the one on which a trade settles. A calendar is a small dimension: one row a day."""
    days = load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).filter(F.dayofweek("day").between(2, 6)).distinct()
    w = Window.orderBy("day")
    return days.select("day", F.row_number().over(w).cast("long").alias("session"), F.lead("day", 2).over(w).alias("settles"), F.quarter("day").cast("long").alias("quarter"))

"""Executions, positions, order rules and sizes.

Executions are trades of a part: flag R sells, others buy. An order book is the
lines of one order; quotes and marks are events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import last_n, series
from marketloom.operators.ledger import call_auction, moving_average_cost, walk_depth
from marketloom.operators.relational import asof_backward
from marketloom.plans.catalog import query
from marketloom.plans.risk import r6
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bars, load, stocks

SQL_EXECUTIONS = """executions AS (
  SELECT l_partkey AS symbol, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS seq, CAST(l_shipdate AS DATE) AS day,
    CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS shares, l_extendedprice AS gross, l_extendedprice * l_tax AS fee, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.001 ELSE 0 END AS tax FROM lineitem
)"""
#: The same recurrence as a fold over each symbol's list, to hold the windows against.
SQL_LEDGER = f"""{SQL_EXECUTIONS}, folded AS (
  SELECT symbol, list_reduce(list({{'q': CASE side WHEN 'BUY' THEN shares ELSE -shares END, 'net': gross + fee, 'cash': gross - fee - tax, 'pnl': 0.0, 'sold': 0.0, 'sound': true}} ORDER BY seq),
    lambda a, x: {{'q': a.q + x.q, 'net': CASE WHEN x.q > 0 THEN a.net + x.net WHEN a.q > 0 THEN a.net * (1 + x.q / a.q) ELSE 0 END, 'cash': x.cash,
      'pnl': a.pnl + CASE WHEN x.q > 0 OR a.q <= 0 THEN 0 ELSE x.cash + a.net * x.q / a.q END, 'sold': a.sold + CASE WHEN x.q > 0 OR a.q <= 0 THEN 0 ELSE -a.net * x.q / a.q END, 'sound': a.sound AND a.q + x.q >= 0}},
    {{'q': 0.0, 'net': 0.0, 'cash': 0.0, 'pnl': 0.0, 'sold': 0.0, 'sound': true}}) AS s FROM executions GROUP BY symbol
)"""


def executions(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem")
    sells = F.col("l_returnflag") == "R"
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    gross = F.col("l_extendedprice")
    return l.select(
        F.col("l_partkey").alias("symbol"), order.alias("at"), F.col("l_shipdate").cast("date").alias("day"), F.when(sells, "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("shares"), gross.alias("gross"), (gross * F.col("l_tax")).alias("fee"), F.when(sells, gross * 0.001).otherwise(0.0).alias("tax"),
    )


@query("ledger_moving_average", f"WITH {SQL_LEDGER}" + """, t AS (SELECT symbol, sum(fee + tax) AS fees, count(*) FILTER (side = 'SELL') AS sales FROM executions GROUP BY symbol)
SELECT symbol, s.sound AS complete, sales, CASE WHEN s.sound THEN round(s.q, 2) END AS quantity, CASE WHEN s.sound THEN round(s.net, 2) END AS cost, CASE WHEN s.sound THEN round(s.pnl, 2) END AS realised, CASE WHEN s.sound THEN round(fees, 2) END AS fees FROM folded JOIN t USING (symbol)""")
def ledger_moving_average(spark: SparkSession, d: str) -> DataFrame:
    """Realised profit and remaining cost by symbol; a book that sold what it didn't hold gives none."""
    r = moving_average_cost(executions(spark, d), "symbol", "at")
    g = r.groupBy("symbol").agg(
        (F.min("quantity") >= 0).alias("complete"), F.count_if(F.col("side") == "SELL").alias("sales"), F.max_by("quantity", "at").alias("quantity"), F.max_by("cost", "at").alias("cost"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("realised"), F.sum(F.col("fee") + F.col("tax")).alias("fees"),
    )
    return g.select("symbol", "complete", "sales", *[F.when(F.col("complete"), F.round(c, 2)).alias(c) for c in ("quantity", "cost", "realised", "fees")])


@query("depth_walk_fill", """WITH l AS (SELECT l_orderkey AS book, l_extendedprice / l_quantity AS p, sum(l_quantity) AS v FROM lineitem WHERE l_quantity > 0 AND l_quantity = floor(l_quantity) AND l_extendedprice > 0 GROUP BY ALL),
s AS (SELECT book, CASE WHEN p < 500 THEN round(p * 1000) ELSE p END AS p, v FROM l), f AS (SELECT book, p, greatest(0, least(v, 60 - coalesce(sum(v) OVER (PARTITION BY book ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS filled FROM (SELECT book, p, sum(v) AS v FROM s WHERE p <= 5000 GROUP BY ALL))
SELECT book, CASE WHEN sum(filled) = 60 THEN round(sum(filled * p) / 60, 6) END AS price, CASE WHEN sum(filled) = 60 THEN round(sum(filled * p), 5) END AS notional FROM f GROUP BY book""")
def depth_walk_fill(spark: SparkSession, d: str) -> DataFrame:
    """The price of buying 60 shares at 5000 at most, level by level."""
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))
    out = walk_depth(l, "book", "price", "volume", 60, limit=5000.0)
    return out.select("book", F.round("price", 6).alias("price"), F.round("notional", 5).alias("notional"))


@query("call_auction_price", """WITH o AS (SELECT l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, round(l_extendedprice / l_quantity, -2) AS price, l_quantity AS volume FROM lineitem),
a AS (SELECT symbol, price, sum(volume) FILTER (side = 'BUY') AS bid, sum(volume) FILTER (side = 'SELL') AS ask FROM o GROUP BY ALL), r AS (SELECT symbol, avg(price) AS reference FROM o GROUP BY symbol),
c AS (SELECT symbol, price, coalesce(sum(bid) OVER (PARTITION BY symbol ORDER BY price DESC), 0) AS demand, coalesce(sum(ask) OVER (PARTITION BY symbol ORDER BY price), 0) AS supply FROM a)
SELECT symbol, price, least(demand, supply) AS matched FROM c JOIN r USING (symbol) WHERE least(demand, supply) > 0
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY least(demand, supply) DESC, abs(demand - supply), round(abs(price - reference), 6), price DESC) = 1""")
def call_auction_price(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem")
    o = l.select(F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), -2).alias("price"), F.col("l_quantity").alias("volume"))
    reference = o.groupBy("symbol").agg(F.avg("price").alias("reference"))
    return call_auction(o.join(reference, "symbol"), "symbol", "reference")


@query("position_marks", """WITH p AS (SELECT user_id, ts, event_id, sum(CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS held FROM events WHERE event_type IN ('purchase', 'signup')),
m AS (SELECT user_id, ts, max(value) AS mark FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, held, round(m.mark, 6) AS mark, round(held * m.mark, 6) AS market_value, date_diff('second', m.ts, p.ts) > 86400 AS stale FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts""")
def position_marks(spark: SparkSession, d: str) -> DataFrame:
    """What is held after each execution, at the last mark before it; marks over a day old are stale."""
    e = load(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = e.filter(F.col("event_type").isin("purchase", "signup")).select("user_id", "ts", "event_id", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(-1)).over(w).alias("held"))
    m = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("mark"))
    out = asof_backward(p, m, ["user_id"], "ts", {"mark": "mark", "ts": "marked"})
    age = F.unix_timestamp("ts") - F.unix_timestamp("marked")
    return out.select("event_id", "held", r6("mark").alias("mark"), r6(F.col("held") * F.col("mark")).alias("market_value"), (age > 86400).alias("stale"))


@query("quote_marks", """WITH n AS (SELECT max(ts) AS now FROM events), q AS (SELECT user_id, arg_max(value, ts) AS price, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, round(price, 6) AS price, date_diff('second', seen, now) AS age, date_diff('second', seen, now) > 3600 AS stale, CASE WHEN price > 10 AND date_diff('second', seen, now) <= 3600 THEN round(price, 6) END AS mark FROM q, n""")
def quote_marks(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of each symbol and its age; only a fresh one marks a position."""
    e = load(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    q = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max_by("value", "ts").alias("price"), F.max("ts").alias("at"))
    age = F.unix_timestamp(F.date_trunc("second", "now")) - F.unix_timestamp(F.date_trunc("second", "at"))
    # ``now`` is one row.
    q = q.crossJoin(F.broadcast(now)).withColumn("age", age)
    return q.select("user_id", r6("price").alias("price"), "age", (F.col("age") > 3600).alias("stale"), F.when((F.col("price") > 10) & (F.col("age") <= 3600), r6("price")).alias("mark"))


@query("merged_last_values", """SELECT user_id, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase'), 6) AS trade, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'view'), 6) AS quote, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'signup'), 6) AS security, count(*) AS messages, max(ts) AS updated FROM events GROUP BY user_id""", dates=("updated",))
def merged_last_values(spark: SparkSession, d: str) -> DataFrame:
    """Trade, quote and security fields of a symbol, each as of its own last message."""
    at = F.struct("ts", "event_id")
    last = lambda kind: r6(F.max_by("value", F.when(F.col("event_type") == kind, at)))
    return load(spark, d, "events").groupBy("user_id").agg(last("purchase").alias("trade"), last("view").alias("quote"), last("signup").alias("security"), F.count(F.lit(1)).alias("messages"), F.max("ts").alias("updated"))


@query("message_mapping", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'view' THEN 'quote' WHEN 'signup' THEN 'sec-def' WHEN 'error' THEN 'index' ELSE 'foreign' END AS kind, user_id AS symbol, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type IN ('purchase', 'view') THEN round(value * 1000, 0) END AS price, CASE WHEN event_type = 'purchase' THEN CAST(json_extract(props, '$.k') AS BIGINT) * 100 END AS volume FROM events""")
def message_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each type as rows of one shape."""
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    kind = F.when(t == "purchase", "trade").when(t == "view", "quote").when(t == "signup", "sec-def").when(t == "error", "index").otherwise("foreign")
    return load(spark, d, "events").select("event_id", kind.alias("kind"), F.col("user_id").alias("symbol"), k.alias("k"), F.when(t.isin("purchase", "view"), F.round(F.col("value") * 1000, 0)).alias("price"), F.when(t == "purchase", k * 100).alias("volume"))


#: Price up to which a step holds.
STEPS = ((10_000, 10), (50_000, 50))


def tick_step(price: Column) -> Column:
    out = F.when(price < STEPS[0][0], STEPS[0][1])
    for below, step in STEPS[1:]:
        out = out.when(price < below, step)
    return out.otherwise(100)


_STEP = f"CASE {' '.join(f'WHEN p < {b} THEN {s}' for b, s in STEPS)} ELSE 100 END"


@query("price_bands", f"""WITH {SQL_BARS}, x AS (SELECT symbol, date, close AS p, volume, {_STEP} AS step FROM (SELECT symbol, date, close AS p, close, volume FROM bars))
SELECT symbol, date, CAST(step AS INT) AS step, round(floor(p / step) * step, 2) AS rounded, round(floor(p * 1.07 / step) * step, 2) AS ceiling, round(ceil(p * 0.93 / step) * step, 2) AS floor, CAST(CASE WHEN volume < 100 THEN volume ELSE floor(volume / 100) * 100 END AS BIGINT) AS lot FROM x""", dates=("date",))
def price_bands(spark: SparkSession, d: str) -> DataFrame:
    """Price steps, daily limits of 7 % on steps, and whole lots of 100."""
    p, v = F.col("close"), F.col("volume")
    b = bars(spark, d).withColumn("step", tick_step(p))
    s = F.col("step")
    return b.select(
        "symbol", "date", "step", F.round(F.floor(p / s) * s, 2).cast("double").alias("rounded"), F.round(F.floor(p * 1.07 / s) * s, 2).cast("double").alias("ceiling"),
        F.round(F.ceil(p * 0.93 / s) * s, 2).cast("double").alias("floor"), F.when(v < 100, v).otherwise(F.floor(v / 100) * 100).cast("long").alias("lot"),
    )


@query("order_validation", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, l_quantity AS q, hour(o_orderdate) AS h, dayofweek(o_orderdate) AS wd, o_orderstatus, l_returnflag, avg(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey) AS reference FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN q <= 0 OR q <> floor(q) THEN 'QUANTITY' WHEN wd IN (0, 6) THEN 'CLOSED' WHEN price > reference * 1.07 THEN 'ABOVE_CEILING' WHEN price < reference * 0.93 THEN 'BELOW_FLOOR' WHEN CAST(q AS BIGINT) % 10 <> 0 THEN 'ODD_LOT' ELSE 'ACCEPTED' END AS verdict FROM l""")
def order_validation(spark: SparkSession, d: str) -> DataFrame:
    """The first rule an order breaks."""
    l = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    price, q = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity")
    l = l.withColumns({"price": price, "reference": F.avg(price).over(Window.partitionBy("l_partkey"))})
    verdict = (
        F.when((q <= 0) | (q != F.floor(q)), "QUANTITY").when(F.dayofweek("o_orderdate").isin(1, 7), "CLOSED").when(F.col("price") > F.col("reference") * 1.07, "ABOVE_CEILING")
        .when(F.col("price") < F.col("reference") * 0.93, "BELOW_FLOOR").when(q.cast("long") % 10 != 0, "ODD_LOT").otherwise("ACCEPTED")
    )
    return l.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


_HOLDINGS = f"""WITH {SQL_BARS}, {SQL_STOCKS}, h AS (SELECT symbol, sector, date, open, high, low, close, volume, first(close) OVER w AS entry, max(close) OVER w AS peak, row_number() OVER w AS age, count(*) OVER (PARTITION BY symbol) AS life, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS adtv,
  min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS swing FROM bars JOIN stocks USING (symbol) WINDOW w AS (PARTITION BY symbol, date_trunc('year', date) ORDER BY date))"""
NAV, SHARES = 5_000_000.0, 100


def holdings(spark: SparkSession, d: str) -> DataFrame:
    """A position of 100 shares of each symbol, entered with each year's first bar."""
    b = bars(spark, d).join(stocks(spark, d), "symbol")
    w = Window.partitionBy("symbol", F.year("date")).orderBy("date")
    s = series("symbol", "date")
    return b.withColumns({"entry": F.first("close").over(w), "peak": F.max("close").over(w), "age": F.row_number().over(w), "adtv": F.avg("volume").over(last_n(s, 20)), "swing": F.min("low").over(s.rowsBetween(-10, -1))})


@query("stop_loss_ladder", _HOLDINGS + f""", x AS (SELECT *, (close - entry) * {SHARES} / {NAV} AS loss, close / entry - 1 AS gain, CASE WHEN peak >= entry * 1.1 AND peak > entry THEN (peak - close) / (peak - entry) END AS back FROM h)
SELECT symbol, date, round(gain, 6) AS gain, CASE WHEN age <= 1 THEN CASE WHEN loss <= -0.02 THEN 'T25_LOCKED' ELSE 'HOLD' END WHEN loss <= -0.02 THEN 'HARD_STOP' WHEN back >= 0.35 THEN 'TRAILING_STOP' WHEN close < swing THEN 'STRUCTURAL_EXIT'
  WHEN high > low AND (high - greatest(open, close)) / nullif(high - low, 0) > 0.5 AND volume > 1.5 * adtv THEN 'FAST_EXIT' WHEN age > 6 AND gain >= -0.03 AND gain < 0.02 THEN 'TIME_STOP' ELSE 'HOLD' END AS rule FROM x""", dates=("date",))
def stop_loss_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first exit rule a position meets: not settled yet, 2 % of net value, giveback, structure, rejection, time."""
    x = holdings(spark, d).withColumns({"loss": (F.col("close") - F.col("entry")) * SHARES / NAV, "gain": F.col("close") / F.col("entry") - 1, "back": F.when((F.col("peak") >= F.col("entry") * 1.1) & (F.col("peak") > F.col("entry")), (F.col("peak") - F.col("close")) / (F.col("peak") - F.col("entry")))})
    lost = F.col("loss") <= -0.02
    wick = F.try_divide(F.col("high") - F.greatest("open", "close"), F.col("high") - F.col("low"))
    rule = (
        F.when(F.col("age") <= 1, F.when(lost, "T25_LOCKED").otherwise("HOLD")).when(lost, "HARD_STOP").when(F.col("back") >= 0.35, "TRAILING_STOP").when(F.col("close") < F.col("swing"), "STRUCTURAL_EXIT")
        .when((wick > 0.5) & (F.col("volume") > 1.5 * F.col("adtv")), "FAST_EXIT").when((F.col("age") > 6) & (F.col("gain") >= -0.03) & (F.col("gain") < 0.02), "TIME_STOP").otherwise("HOLD")
    )
    return x.select("symbol", "date", r6("gain").alias("gain"), rule.alias("rule"))


@query("hard_law_checks", _HOLDINGS + f""", x AS (SELECT *, least(volume * 0.2, 500) AS q, sum(close * {SHARES}) OVER (PARTITION BY sector, date) AS in_sector FROM h)
SELECT symbol, date, round(q, 4) AS quantity, CASE WHEN adtv IS NULL OR adtv <= 0 THEN 'NO_LIQUIDITY' WHEN close * greatest((close - low) / close, 0.1351) * q > 0.02 * {NAV} THEN 'RISK' WHEN q > 0.15 * adtv THEN 'ORDER_SIZE' WHEN q + {SHARES} > 0.25 * adtv THEN 'POSITION_SIZE'
  WHEN close * ({SHARES} + q) > 0.15 * {NAV} THEN 'STOCK_LIMIT' WHEN in_sector + close * q > 0.35 * {NAV} THEN 'SECTOR_LIMIT' ELSE 'PASS' END AS law FROM x""", dates=("date",))
def hard_law_checks(spark: SparkSession, d: str) -> DataFrame:
    """The first limit a purchase breaks: loss over two falls to the floor, liquidity, concentration."""
    x = holdings(spark, d).withColumns({"q": F.least(F.col("volume") * 0.2, F.lit(500.0)), "in_sector": F.sum(F.col("close") * SHARES).over(Window.partitionBy("sector", "date"))})
    c, q, adtv = F.col("close"), F.col("q"), F.col("adtv")
    law = (
        F.when(adtv.isNull() | (adtv <= 0), "NO_LIQUIDITY").when(c * F.greatest((c - F.col("low")) / c, F.lit(0.1351)) * q > 0.02 * NAV, "RISK").when(q > 0.15 * adtv, "ORDER_SIZE").when(q + SHARES > 0.25 * adtv, "POSITION_SIZE")
        .when(c * (SHARES + q) > 0.15 * NAV, "STOCK_LIMIT").when(F.col("in_sector") + c * q > 0.35 * NAV, "SECTOR_LIMIT").otherwise("PASS")
    )
    return x.select("symbol", "date", F.round("q", 4).alias("quantity"), law.alias("law"))


#: Fixed value: the loss of two falls by the daily limit of 7 %.
_TWO_FLOORS = 1 - 0.93**2


@query("settlement_exposure", _HOLDINGS + f""", x AS (SELECT symbol, date, close, swing, sum(CASE WHEN age <= 2 THEN close * {SHARES} ELSE 0 END) OVER (PARTITION BY date) AS locked, least(0.02 * {NAV} / greatest(CASE WHEN swing < close THEN (close - swing) / close ELSE 0.07 END, {_TWO_FLOORS}), 0.15 * {NAV}) AS safe FROM h)
SELECT symbol, date, round(locked / {NAV} * 100, 4) AS locked_pct, CASE WHEN (locked + close * {SHARES}) / {NAV} * 100 > 35 THEN 0 ELSE CAST(floor(floor(safe / close) / 100) * 100 AS BIGINT) END AS safe_shares,
  CASE WHEN (locked + close * {SHARES}) / {NAV} * 100 > 35 THEN 'LOCKED_LIMIT' WHEN close * {SHARES} > safe * 1.05 THEN 'REDUCE' ELSE 'PASS' END AS verdict FROM x""", dates=("date",))
def settlement_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Shares not settled yet against their limit, and the size that two falls to the floor allow."""
    c = F.col("close")
    x = holdings(spark, d).withColumns({"locked": F.sum(F.when(F.col("age") <= 2, c * SHARES).otherwise(0.0)).over(Window.partitionBy("date")), "safe": F.least(0.02 * NAV / F.greatest(F.when(F.col("swing") < c, (c - F.col("swing")) / c).otherwise(0.07), F.lit(_TWO_FLOORS)), F.lit(0.15 * NAV))})
    over = (F.col("locked") + c * SHARES) / NAV * 100 > 35
    shares = F.when(over, F.lit(0).cast("long")).otherwise((F.floor(F.floor(F.col("safe") / c) / 100) * 100).cast("long"))
    verdict = F.when(over, "LOCKED_LIMIT").when(c * SHARES > F.col("safe") * 1.05, "REDUCE").otherwise("PASS")
    return x.select("symbol", "date", F.round(F.col("locked") / NAV * 100, 4).alias("locked_pct"), shares.alias("safe_shares"), verdict.alias("verdict"))


@query("kelly_by_regime", f"""WITH {SQL_BARS}, r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars), g AS (SELECT symbol, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS p, avg(r) FILTER (r > 0) / nullif(-avg(r) FILTER (r < 0), 0) AS b FROM r WHERE r IS NOT NULL GROUP BY symbol),
s(regime, scale) AS (VALUES ('BULL_TRENDING', 1.0), ('BULL_CHOPPY', 0.75), ('BEAR_BOUNCE', 0.5), ('BEAR_TRENDING', 0.25))
SELECT symbol, regime, round(p, 6) AS win_rate, round(b, 6) AS ratio, round(CASE WHEN b IS NULL OR p - (1 - p) / b <= 0 THEN 0 ELSE least((p - (1 - p) / b) * 0.25 * scale, 0.15) END, 6) AS share FROM g, s""")
def kelly_by_regime(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the Kelly share, scaled by regime and capped at 15 %."""
    b = bars(spark, d)
    r = b.select("symbol", (F.col("close") / F.lag("close").over(series("symbol", "date")) - 1).alias("r")).filter("r IS NOT NULL")
    g = r.groupBy("symbol").agg(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("p"), F.try_divide(F.avg(F.when(F.col("r") > 0, F.col("r"))), -F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("b"))
    scales = F.create_map(*[F.lit(x) for x in ("BULL_TRENDING", 1.0, "BULL_CHOPPY", 0.75, "BEAR_BOUNCE", 0.5, "BEAR_TRENDING", 0.25)])
    g = g.select("symbol", "p", "b", F.explode(scales).alias("regime", "scale"))
    full = F.col("p") - (1 - F.col("p")) / F.col("b")
    share = F.when(F.col("b").isNull() | (full <= 0), 0.0).otherwise(F.least(full * 0.25 * F.col("scale"), F.lit(0.15)))
    return g.select("symbol", "regime", r6("p").alias("win_rate"), r6("b").alias("ratio"), r6(share).alias("share"))


@query("conviction_labels", """WITH t AS (SELECT l_suppkey, 400 * avg(CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 0 END) - 150 AS quality, sum(l_extendedprice * (l_discount - 0.05)) AS result, avg(l_quantity) AS size, 10 * avg(l_discount) AS ml FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey AS symbol, s_acctbal / 110 AS css, quality, CASE WHEN s_acctbal < 0 AND result < 0 THEN 'QUALIFIED' ELSE 'UNQUALIFIED' END AS audit, size > 25.5 AS cyclical, ml FROM supplier LEFT JOIN t ON l_suppkey = s_suppkey),
b AS (SELECT *, CASE WHEN css >= 85 THEN 'A+' WHEN css >= 75 THEN 'A' WHEN css >= 60 THEN 'B' WHEN css >= 45 THEN 'C' ELSE 'D' END AS base FROM s), g AS (SELECT *, CASE WHEN audit <> 'UNQUALIFIED' THEN 'E' WHEN quality < 20 AND NOT cyclical AND base IN ('A+', 'A', 'B') THEN 'C' ELSE base END AS gated FROM b)
SELECT symbol, base, gated, CASE WHEN ml <= 0.35 AND gated IN ('A+', 'A', 'B', 'C') THEN 'D' WHEN ml >= 0.7 AND gated = 'A' THEN 'A+' WHEN ml >= 0.7 AND gated = 'B' THEN 'A' WHEN ml >= 0.7 AND gated = 'C' THEN 'B' ELSE gated END AS conviction FROM g""")
def conviction_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of a score, lowered for poor quality and by a model's veto, raised by its assent.

    Quality is the share of lines that are filed, the audit is qualified for a debtor that
    lost, a cyclical one ships in large lots, and the mean discount stands for the model.
    """
    t = load(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (400 * F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)) - 150).alias("quality"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("result"),
        F.avg("l_quantity").alias("size"), (10 * F.avg("l_discount")).alias("ml"),
    )
    s = load(spark, d, "supplier").join(t, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    qualified = F.coalesce((F.col("s_acctbal") < 0) & (F.col("result") < 0), F.lit(False))
    s = s.select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") / 110).alias("css"), "quality", qualified.alias("qualified"), (F.col("size") > 25.5).alias("cyclical"), "ml")
    css, ml, gated = F.col("css"), F.col("ml"), F.col("gated")
    s = s.withColumn("base", F.when(css >= 85, "A+").when(css >= 75, "A").when(css >= 60, "B").when(css >= 45, "C").otherwise("D"))
    s = s.withColumn("gated", F.when(F.col("qualified"), "E").when((F.col("quality") < 20) & ~F.col("cyclical") & F.col("base").isin("A+", "A", "B"), "C").otherwise(F.col("base")))
    up = F.when((ml >= 0.7) & (gated == "A"), "A+").when((ml >= 0.7) & (gated == "B"), "A").when((ml >= 0.7) & (gated == "C"), "B")
    return s.select("symbol", "base", "gated", F.coalesce(F.when((ml <= 0.35) & gated.isin("A+", "A", "B", "C"), "D"), up, gated).alias("conviction"))


@query("order_slices", """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 100) * 100 AS BIGINT) AS shares, CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 6 END AS slices FROM orders), k AS (SELECT *, unnest(range(CAST(slices AS BIGINT))) AS slice FROM o),
q AS (SELECT *, CAST(floor(shares / CAST(slices AS DOUBLE) / 100) * 100 AS BIGINT) AS each FROM k) SELECT o_orderkey, slice, CASE WHEN slice = slices - 1 THEN shares - each * (slices - 1) ELSE each END AS shares, slice * (240 // slices) AS minute FROM q""")
def order_slices(spark: SparkSession, d: str) -> DataFrame:
    """An order in equal lots over a session of 240 minutes; the last slice takes the rest."""
    o = load(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 100) * 100).cast("long").alias("shares"), F.when(F.col("o_orderpriority").startswith("1"), 3).otherwise(6).cast("long").alias("slices"))
    o = o.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    each = (F.floor(F.col("shares") / F.col("slices") / 100) * 100).cast("long")
    return o.select("o_orderkey", "slice", F.when(F.col("slice") == F.col("slices") - 1, F.col("shares") - each * (F.col("slices") - 1)).otherwise(each).alias("shares"), (F.col("slice") * F.expr("240 div slices")).alias("minute"))


@query("execution_costs", f"""WITH {SQL_EXECUTIONS}, v AS (SELECT *, gross / shares AS price, avg(shares) OVER (PARTITION BY symbol) AS adtv FROM executions), c AS (SELECT *, least(0.02, 0.001 * sqrt(shares / nullif(adtv, 0))) AS impact, gross * 0.0015 AS commission FROM v)
SELECT symbol, side, count(*) AS trades, round(sum(gross * impact), 2) AS slippage, round(sum(commission), 2) AS commission, round(sum(tax), 2) AS tax, round(sum(CASE side WHEN 'BUY' THEN gross * (1 + impact) + commission ELSE gross * (1 - impact) - commission - tax END), 2) AS settled FROM c GROUP BY symbol, side""")
def execution_costs(spark: SparkSession, d: str) -> DataFrame:
    """Commission, tax and an impact growing with the square root of the share of usual volume."""
    e = executions(spark, d).withColumn("adtv", F.avg("shares").over(Window.partitionBy("symbol")))
    e = e.withColumns({"impact": F.least(F.lit(0.02), 0.001 * F.sqrt(F.try_divide("shares", "adtv"))), "commission": F.col("gross") * 0.0015})
    paid = F.when(F.col("side") == "BUY", F.col("gross") * (1 + F.col("impact")) + F.col("commission")).otherwise(F.col("gross") * (1 - F.col("impact")) - F.col("commission") - F.col("tax"))
    return e.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum(F.col("gross") * F.col("impact")), 2).alias("slippage"), F.round(F.sum("commission"), 2).alias("commission"), F.round(F.sum("tax"), 2).alias("tax"), F.round(F.sum(paid), 2).alias("settled"))


@query("rebalance_orders", f"""WITH {SQL_BARS}, {SQL_STOCKS}, l AS (SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY symbol), t AS (SELECT symbol, close, market_cap / sum(market_cap) OVER () AS target, {SHARES} * close / {NAV} AS current FROM l JOIN stocks USING (symbol) WHERE market_cap IS NOT NULL)
SELECT symbol, round(current, 6) AS current, round(target, 6) AS target, CASE WHEN abs(target - current) < 0.02 THEN 'HOLD' WHEN target > current THEN 'BUY' ELSE 'SELL' END AS action, CASE WHEN abs(target - current) < 0.02 THEN 0 ELSE CAST(floor(abs(target - current) * {NAV} / close / 100) * 100 AS BIGINT) END AS shares FROM t""")
def rebalance_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders in whole lots towards target weights, none within 2 % of net value."""
    l = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("close")).join(stocks(spark, d).filter("market_cap IS NOT NULL"), "symbol")
    total = stocks(spark, d).join(bars(spark, d).select("symbol").distinct(), "symbol", "left_semi").agg(F.sum("market_cap").alias("total"))
    t = l.crossJoin(F.broadcast(total)).select("symbol", "close", (F.col("market_cap") / F.col("total")).alias("target"), (SHARES * F.col("close") / NAV).alias("current"))
    gap = F.col("target") - F.col("current")
    near = F.abs(gap) < 0.02
    shares = F.when(near, F.lit(0).cast("long")).otherwise((F.floor(F.abs(gap) * NAV / F.col("close") / 100) * 100).cast("long"))
    return t.select("symbol", r6("current").alias("current"), r6("target").alias("target"), F.when(near, "HOLD").when(gap > 0, "BUY").otherwise("SELL").alias("action"), shares.alias("shares"))

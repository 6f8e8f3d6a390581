"""Technical indicators over the bars of each symbol; all windows of a query share one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.frames import change, island, last_n, rolling, series, so_far, true_range
from marketloom.operators import recursive
from marketloom.plans.catalog import query
from marketloom.sources.tables import SQL_BARS, bars, load

BARS = f"WITH {SQL_BARS}"
KEY = ("symbol", "date")


def W() -> WindowSpec:
    return series("symbol", "date")


def out(df: DataFrame, **columns) -> DataFrame:
    return df.select(*KEY, *[F.round(c, 6).alias(n) for n, c in columns.items()])


def guarded(sql: str, n: int, x: str, w: str = "s") -> str:
    frame = f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {sql} OVER {frame} END"


@query("moving_averages", f"""{BARS} SELECT symbol, date, {", ".join(f"round({guarded('avg(close)', n, 'close')}, 6) AS ma{n}" for n in (5, 10, 20, 50))},
  round((close + 0) / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 0), 6) AS price_to_volume FROM bars""", dates=("date",))
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return out(bars(spark, d), **{f"ma{n}": rolling(F.avg, c, W(), n) for n in (5, 10, 20, 50)}, price_to_volume=F.try_divide(c, F.avg("volume").over(last_n(W(), 20))))


@query("rsi_simple", f"""{BARS}, x AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM bars),
y AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss FROM x),
z AS (SELECT symbol, date, {guarded('avg(gain)', 14, 'gain')} AS g, nullif({guarded('avg(loss)', 14, 'loss')}, 0) AS l FROM y)
SELECT symbol, date, round(100 - 100 / (1 + g / l), 6) AS rsi_14 FROM z""", dates=("date",))
def rsi_simple(spark: SparkSession, d: str) -> DataFrame:
    """Relative strength by plain means of gains and losses (not Wilder's)."""
    b = bars(spark, d).withColumn("d", F.col("close") - F.lag("close").over(W()))
    b = b.withColumns({"gain": F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0))), "loss": F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0)))})
    g, l = rolling(F.avg, F.col("gain"), W(), 14), rolling(F.avg, F.col("loss"), W(), 14)
    return out(b, rsi_14=100 - 100 / (1 + F.when(l != 0, g / l)))


EMA = """r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
e AS (SELECT symbol, date, rn, close AS f, close AS s, 0.0::DOUBLE AS g FROM r WHERE rn = 1
  UNION ALL SELECT r.symbol, r.date, r.rn, e.f + (r.close - e.f) * 2 / 13, e.s + (r.close - e.s) * 2 / 27,
    e.g + ((e.f + (r.close - e.f) * 2 / 13) - (e.s + (r.close - e.s) * 2 / 27) - e.g) * 2 / 10 FROM e JOIN r ON r.symbol = e.symbol AND r.rn = e.rn + 1)"""


@query("macd", f"WITH RECURSIVE {SQL_BARS}, {EMA} SELECT symbol, date, round(f - s, 4) AS macd, round(g, 4) AS signal, round(f - s - g, 4) AS histogram FROM e", dates=("date",))
def macd(spark: SparkSession, d: str) -> DataFrame:
    """Difference of exponential means of 12 and 26 bars, seeded by the first value, and its mean of 9."""
    m = recursive.macd(bars(spark, d), "symbol", "date", "close")
    r = lambda c: F.round(c, 4).alias(c)
    return m.select(*KEY, r("macd"), r("signal"), r("histogram"))


@query("heikin_ashi", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, (open + high + low + close) / 4 AS hc FROM bars),
e AS (SELECT symbol, date, rn, hc, (open + close) / 2 AS ho, high, low FROM r WHERE rn = 1 UNION ALL SELECT r.symbol, r.date, r.rn, r.hc, (e.ho + e.hc) / 2, r.high, r.low FROM e JOIN r ON r.symbol = e.symbol AND r.rn = e.rn + 1)
SELECT symbol, date, round(ho, 8) AS ha_open, round(hc, 8) AS ha_close, round(greatest(high, ho, hc), 8) AS ha_high, round(least(low, ho, hc), 8) AS ha_low FROM e""", dates=("date",))
def heikin_ashi(spark: SparkSession, d: str) -> DataFrame:
    h = recursive.heikin_ashi(bars(spark, d), "symbol", "date")
    return h.select(*KEY, *[F.round(c, 8).alias(c) for c in ("ha_open", "ha_close", "ha_high", "ha_low")])


_ATR = f"""r AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS m FROM r), a AS (SELECT symbol, k, m AS atr FROM s WHERE k = 10 UNION ALL SELECT s.symbol, s.k, a.atr + (s.tr - a.atr) / 10 FROM a JOIN s ON s.symbol = a.symbol AND s.k = a.k + 1)"""


@query("supertrend", f"""WITH RECURSIVE {SQL_BARS}, {_ATR}, b AS (SELECT r.symbol, r.date, r.k, close AS c, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS low FROM r JOIN a ON a.symbol = r.symbol AND a.k = r.k),
e AS (SELECT symbol, date, k, c, up, low, CASE WHEN c > up THEN 1 WHEN c < low THEN -1 ELSE 1 END AS trend FROM b WHERE k = 10
UNION ALL SELECT x.symbol, x.date, x.k, x.c, x.up, x.low, CASE WHEN x.c > x.up THEN 1 WHEN x.c < x.low THEN -1 ELSE x.trend END FROM (SELECT b.symbol, b.date, b.k, b.c, CASE WHEN b.up > e.up AND e.c <= e.up THEN e.up ELSE b.up END AS up, CASE WHEN b.low < e.low AND e.c >= e.low THEN e.low ELSE b.low END AS low, e.trend FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1) x)
SELECT r.symbol, r.date, round(CASE WHEN trend > 0 THEN e.low ELSE e.up END, 4) AS supertrend, CAST(coalesce(trend, 0) AS BIGINT) AS trend FROM r LEFT JOIN e ON e.symbol = r.symbol AND e.k = r.k""", dates=("date",))
def supertrend(spark: SparkSession, d: str) -> DataFrame:
    """Wilder's range bands with a flipping trend."""
    return recursive.supertrend(bars(spark, d), "symbol", "date", 10, 3.0).withColumn("supertrend", F.round("supertrend", 4))


@query("kaufman_average", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, close, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 10) OVER w) AS far, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
x AS (SELECT *, (coalesce(far / nullif(sum(step) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), 0), 0) * (2 / 3.0 - 2 / 31.0) + 2 / 31.0) ** 2 AS rate FROM r),
e AS (SELECT symbol, date, k, close AS kama FROM x WHERE k = 11 UNION ALL SELECT x.symbol, x.date, x.k, e.kama + x.rate * (x.close - e.kama) FROM e JOIN x ON x.symbol = e.symbol AND x.k = e.k + 1)
SELECT r.symbol, r.date, round(kama, 5) AS kama FROM r LEFT JOIN e ON e.symbol = r.symbol AND e.k = r.k""", dates=("date",))
def kaufman_average(spark: SparkSession, d: str) -> DataFrame:
    return recursive.kama(bars(spark, d), "symbol", "date", "close", 10).withColumn("kama", F.round("kama", 5))


@query("rsi_wilder", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, close - lag(close) OVER w AS step, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s AS (SELECT *, avg(greatest(step, 0)) OVER w AS g, avg(greatest(-step, 0)) OVER w AS l FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)),
e AS (SELECT symbol, date, k, g, l FROM s WHERE k = 15 UNION ALL SELECT r.symbol, r.date, r.k, e.g + (greatest(r.step, 0) - e.g) / 14, e.l + (greatest(-r.step, 0) - e.l) / 14 FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k + 1)
SELECT r.symbol, r.date, round(CASE WHEN e.l = 0 THEN 100 ELSE 100 - 100 / (1 + e.g / nullif(e.l, 0)) END, 6) AS rsi FROM r LEFT JOIN e ON e.symbol = r.symbol AND e.k = r.k""", dates=("date",))
def rsi_wilder(spark: SparkSession, d: str) -> DataFrame:
    return recursive.rsi_wilder(bars(spark, d), "symbol", "date", "close", 14).withColumn("rsi", F.round("rsi", 6))


@query("renko_bricks", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, (close - first) / (first * 0.25) AS place, first, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM (SELECT *, first(close) OVER (PARTITION BY symbol ORDER BY date) AS first FROM bars)),
x AS (SELECT symbol, date, k, first, CAST(floor(place + 1e-9) AS BIGINT) AS high, CAST(ceil(place - 1e-9) AS BIGINT) AS low FROM r),
e AS (SELECT symbol, date, k, first, 0::BIGINT AS top, 0::BIGINT AS bottom, 0::BIGINT AS ups, 0::BIGINT AS downs, 0::BIGINT AS had_top, 0::BIGINT AS had_bottom FROM x WHERE k = 1
UNION ALL SELECT x.symbol, x.date, x.k, x.first, CASE WHEN x.high > e.top THEN x.high WHEN x.low < e.bottom THEN x.low + 1 ELSE e.top END, CASE WHEN x.high > e.top THEN x.high - 1 WHEN x.low < e.bottom THEN x.low ELSE e.bottom END,
  greatest(x.high - e.top, 0), greatest(e.bottom - x.low, 0), e.top, e.bottom FROM e JOIN x ON x.symbol = e.symbol AND x.k = e.k + 1),
b AS (SELECT symbol, date, k, first, n, CASE WHEN ups > 0 THEN had_top + n ELSE had_bottom - n END AS opened, CASE WHEN ups > 0 THEN 1 ELSE -1 END AS way FROM (SELECT *, unnest(range(ups + downs)) AS n FROM e))
SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY k, n) - 1 AS brick, round(first * (1 + 0.25 * opened), 6) AS brick_open, round(first * (1 + 0.25 * (opened + way)), 6) AS brick_close, CAST(way AS BIGINT) AS direction FROM b""", dates=("date",))
def renko_bricks(spark: SparkSession, d: str) -> DataFrame:
    """Bricks of a fixed share of each symbol's first close: any number of rows out for a row in."""
    b = recursive.renko(bars(spark, d), "symbol", "date", "close", 0.25)
    return b.withColumns({c: F.round(c, 6) for c in ("brick_open", "brick_close")})


@query("bollinger", f"""{BARS}, x AS (SELECT symbol, date, close, {guarded('avg(close)', 20, 'close')} AS m, {guarded('stddev_samp(close)', 20, 'close')} AS s FROM bars)
SELECT symbol, date, round(m, 6) AS middle, round(m + 2 * s, 6) AS upper, round(m - 2 * s, 6) AS lower, round(4 * s / m, 6) AS width, round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) AS pct FROM x""", dates=("date",))
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumns({"m": rolling(F.avg, F.col("close"), W(), 20), "s": rolling(F.stddev_samp, F.col("close"), W(), 20)})
    m, s, c = F.col("m"), F.col("s"), F.col("close")
    return out(b, middle=m, upper=m + 2 * s, lower=m - 2 * s, width=4 * s / m, pct=F.try_divide(c - (m - 2 * s), 4 * s))


TR = "greatest(high - low, abs(high - prev), abs(low - prev))"


@query("adx_simple", f"""{BARS}, x AS (SELECT *, lag(close) OVER w AS prev, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
y AS (SELECT *, {TR} AS tr, CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END END AS up,
  CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END END AS down FROM x),
z AS (SELECT symbol, date, {guarded('avg(tr)', 14, 'tr')} AS atr, {guarded('avg(up)', 14, 'up')} AS u, {guarded('avg(down)', 14, 'down')} AS dn FROM y),
k AS (SELECT *, 100 * u / nullif(atr, 0) AS plus_di, 100 * dn / nullif(atr, 0) AS minus_di FROM z), m AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM k)
SELECT symbol, date, round(atr, 6) AS atr_14, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round({guarded('avg(dx)', 14, 'dx')}, 6) AS adx_14 FROM m""", dates=("date",))
def adx_simple(spark: SparkSession, d: str) -> DataFrame:
    """Directional movement by plain means."""
    b = bars(spark, d)
    up, down = F.col("high") - F.lag("high").over(W()), F.lag("low").over(W()) - F.col("low")
    b = b.withColumns({"up": up, "down": down, "tr": F.when(up.isNotNull(), true_range(F.col("high"), F.col("low"), F.col("close"), W())).otherwise(F.col("high") - F.col("low"))})
    u, n = F.col("up"), F.col("down")
    b = b.withColumns({"pdm": F.when(u.isNotNull(), F.when((u > n) & (u > 0), u).otherwise(0.0)), "ndm": F.when(u.isNotNull(), F.when((n > u) & (n > 0), n).otherwise(0.0))})
    b = b.withColumns({k: rolling(F.avg, F.col(x), W(), 14) for k, x in (("atr", "tr"), ("p", "pdm"), ("q", "ndm"))})
    b = b.withColumns({"plus_di": F.try_divide(100 * F.col("p"), F.col("atr")), "minus_di": F.try_divide(100 * F.col("q"), F.col("atr"))})
    b = b.withColumn("dx", F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return out(b, atr_14=F.col("atr"), plus_di=F.col("plus_di"), minus_di=F.col("minus_di"), adx_14=rolling(F.avg, F.col("dx"), W(), 14))


@query("money_flow", f"""{BARS}, x AS (SELECT *, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER (PARTITION BY symbol ORDER BY date) AS pt FROM bars),
y AS (SELECT *, CASE WHEN pt IS NOT NULL THEN CASE WHEN tp > pt THEN tp * volume ELSE 0 END END AS pos, CASE WHEN pt IS NOT NULL THEN CASE WHEN tp < pt THEN tp * volume ELSE 0 END END AS neg,
  CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END AS mfv FROM x)
SELECT symbol, date, round(100 - 100 / (1 + {guarded('sum(pos)', 14, 'pos')} / nullif({guarded('sum(neg)', 14, 'neg')}, 0)), 6) AS mfi_14,
  round(sum(mfv) OVER (PARTITION BY symbol ORDER BY date), 4) AS adl, round({guarded('sum(mfv)', 20, 'mfv')} / nullif({guarded('sum(volume)', 20, 'volume')}, 0), 6) AS cmf_20 FROM y""", dates=("date",))
def money_flow(spark: SparkSession, d: str) -> DataFrame:
    """Money flow index, accumulation line and its ratio to volume."""
    b = bars(spark, d).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    before, tp, v = F.lag("tp").over(W()), F.col("tp"), F.col("volume")
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    b = b.withColumns({
        "pos": F.when(before.isNotNull(), F.when(tp > before, tp * v).otherwise(0.0)), "neg": F.when(before.isNotNull(), F.when(tp < before, tp * v).otherwise(0.0)),
        "mfv": F.when(h > l, ((c - l) - (h - c)) / (h - l) * v).otherwise(0.0),
    })
    s = lambda x, n: rolling(F.sum, F.col(x), W(), n)
    return b.select(*KEY, F.round(100 - 100 / (1 + F.try_divide(s("pos", 14), s("neg", 14))), 6).alias("mfi_14"), F.round(F.sum("mfv").over(so_far(W())), 4).alias("adl"), F.round(F.try_divide(s("mfv", 20), s("volume", 20)), 6).alias("cmf_20"))


@query("on_balance_volume", f"""{BARS}, x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars)
SELECT symbol, date, round(sum(CASE WHEN close > prev THEN volume WHEN close < prev THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date), 4) AS obv FROM x""", dates=("date",))
def on_balance_volume(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumn("s", F.coalesce(F.signum(F.col("close") - F.lag("close").over(W())), F.lit(0.0)) * F.col("volume"))
    return b.select(*KEY, F.round(F.sum("s").over(so_far(W())), 4).alias("obv"))


@query("stochastic_channels", f"""{BARS}, x AS (SELECT *, {guarded('min(low)', 14, 'low')} AS lo, {guarded('max(high)', 14, 'high')} AS hi, (high + low + close) / 3 AS tp FROM bars),
y AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM x)
SELECT symbol, date, round(k, 6) AS stoch_k, round({guarded('avg(k)', 3, 'k')}, 6) AS stoch_d, round(100 * (close - hi) / nullif(hi - lo, 0), 6) AS williams_r, round(hi, 6) AS upper, round(lo, 6) AS lower FROM y""", dates=("date",))
def stochastic_channels(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumns({"lo": rolling(F.min, F.col("low"), W(), 14), "hi": rolling(F.max, F.col("high"), W(), 14)})
    wide = F.col("hi") - F.col("lo")
    b = b.withColumn("k", F.try_divide(100 * (F.col("close") - F.col("lo")), wide))
    return out(b, stoch_k=F.col("k"), stoch_d=rolling(F.avg, F.col("k"), W(), 3), williams_r=F.try_divide(100 * (F.col("close") - F.col("hi")), wide), upper=F.col("hi"), lower=F.col("lo"))


@query("volatility_momentum", f"""{BARS}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars)
SELECT symbol, date, round({guarded('stddev_samp(r)', 10, 'r')} * sqrt(252) * 100, 4) AS volatility_10, round({guarded('stddev_samp(r)', 20, 'r')} * sqrt(252) * 100, 4) AS volatility_20,
  round(r, 6) AS momentum_1, round(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS momentum_5, round(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS momentum_20 FROM x""", dates=("date",))
def volatility_momentum(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumn("r", change(F.col("close"), W()))
    vol = lambda n: F.round(rolling(F.stddev_samp, F.col("r"), W(), n) * F.sqrt(F.lit(252.0)) * 100, 4).alias(f"volatility_{n}")
    mom = lambda n: F.round(change(F.col("close"), W(), n), 6).alias(f"momentum_{n}")
    return b.select(*KEY, vol(10), vol(20), mom(1), mom(5), mom(20))


@query("limit_streaks", f"""{BARS}, x AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 >= 0.069, false) AS up FROM bars),
y AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date) AS island FROM x)
SELECT symbol, date, up AS at_ceiling, CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY date) AS BIGINT) AS streak FROM y""", dates=("date",))
def limit_streaks(spark: SparkSession, d: str) -> DataFrame:
    """How many bars in a row closed at the ceiling."""
    b = bars(spark, d).withColumn("up", F.coalesce(change(F.col("close"), W()) >= 0.069, F.lit(False)))
    b = b.withColumn("island", island(F.col("up"), W()))
    streak = F.sum(F.col("up").cast("long")).over(so_far(series(["symbol", "island"], "date")))
    return b.select(*KEY, F.col("up").alias("at_ceiling"), streak.alias("streak"))


_BODY = "abs(close - open)"


@query("candle_patterns", f"""{BARS}, x AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close, 2) OVER w AS pc2, lag(open, 2) OVER w AS po2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, coalesce({_BODY} <= 0.1 * (high - low), false) AS doji,
  coalesce(least(open, close) - low >= 2 * {_BODY} AND high - greatest(open, close) <= {_BODY} * 0.5 AND high > low, false) AS hammer,
  coalesce(high - greatest(open, close) >= 2 * {_BODY} AND least(open, close) - low <= {_BODY} * 0.5 AND high > low, false) AS shooting_star,
  coalesce(pc < po AND close > open AND close >= po AND open <= pc, false) AS bullish_engulfing, coalesce(pc > po AND close < open AND close <= po AND open >= pc, false) AS bearish_engulfing,
  coalesce(high < ph AND low > pl, false) AS inside_bar, coalesce(high > ph AND low < pl, false) AS outside_bar,
  coalesce(close > open AND pc > po AND pc2 > po2 AND close > pc AND pc > pc2, false) AS three_soldiers FROM x""", dates=("date",))
def candle_patterns(spark: SparkSession, d: str) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc, ph, pl, pc2, po2 = (F.lag(x, n).over(W()) for x, n in (("open", 1), ("close", 1), ("high", 1), ("low", 1), ("close", 2), ("open", 2)))
    body, top, bottom = F.abs(c - o), F.greatest(o, c), F.least(o, c)
    flags = {
        "doji": body <= 0.1 * (h - l),
        "hammer": (bottom - l >= 2 * body) & (h - top <= body * 0.5) & (h > l),
        "shooting_star": (h - top >= 2 * body) & (bottom - l <= body * 0.5) & (h > l),
        "bullish_engulfing": (pc < po) & (c > o) & (c >= po) & (o <= pc),
        "bearish_engulfing": (pc > po) & (c < o) & (c <= po) & (o >= pc),
        "inside_bar": (h < ph) & (l > pl),
        "outside_bar": (h > ph) & (l < pl),
        "three_soldiers": (c > o) & (pc > po) & (pc2 > po2) & (c > pc) & (pc > pc2),
    }
    return bars(spark, d).select(*KEY, *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()])


@query("swing_pivots", f"""{BARS}, x AS (SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT symbol, date, CASE WHEN high = hi THEN 'high' ELSE 'low' END AS kind, round(CASE WHEN high = hi THEN high ELSE low END, 6) AS price FROM x WHERE n = 7 AND (high = hi OR low = lo)""", dates=("date",))
def swing_pivots(spark: SparkSession, d: str) -> DataFrame:
    w = W().rowsBetween(-3, 3)
    b = bars(spark, d).withColumns({"hi": F.max("high").over(w), "lo": F.min("low").over(w), "n": F.count(F.lit(1)).over(w)})
    top = F.col("high") == F.col("hi")
    b = b.filter((F.col("n") == 7) & (top | (F.col("low") == F.col("lo"))))
    return b.select(*KEY, F.when(top, "high").otherwise("low").alias("kind"), F.round(F.when(top, F.col("high")).otherwise(F.col("low")), 6).alias("price"))


@query("weighted_averages", f"""{BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM bars)
SELECT symbol, date, round({guarded('sum(close * volume)', 10, 'close')} / nullif({guarded('sum(volume)', 10, 'volume')}, 0), 6) AS vwma_10,
  round(CASE WHEN count(close) OVER f = 10 THEN (sum(close * t) OVER f - (t - 10) * sum(close) OVER f) / 55 END, 6) AS wma_10,
  round(CASE WHEN count(close) OVER f = 10 THEN regr_intercept(close, t) OVER f + regr_slope(close, t) OVER f * t END, 6) AS lsma_10 FROM x WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)""", dates=("date",))
def weighted_averages(spark: SparkSession, d: str) -> DataFrame:
    """Means weighted by volume and by age, and the end of a fitted line."""
    b = bars(spark, d).withColumn("t", F.row_number().over(W()))
    f = last_n(W(), 10)
    c, v, t = F.col("close"), F.col("volume"), F.col("t")
    full = F.count(c).over(f) == 10
    wma = (F.sum(c * t).over(f) - (t - 10) * F.sum(c).over(f)) / 55
    slope = F.covar_samp(c, t).over(f) / F.var_samp(t).over(f)
    line = F.avg(c).over(f) + slope * (t - F.avg(t).over(f))
    return out(b, vwma_10=F.try_divide(rolling(F.sum, c * v, W(), 10), rolling(F.sum, v, W(), 10)), wma_10=F.when(full, wma), lsma_10=F.when(full, line))


@query("volume_profile", f"""{BARS}, r AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY 1),
x AS (SELECT symbol, CAST(least(23, floor(24 * (price - lo) / nullif(hi - lo, 0))) AS BIGINT) AS bin, quantity FROM trades JOIN r USING (symbol)), y AS (SELECT symbol, bin, sum(quantity) AS volume FROM x GROUP BY ALL)
SELECT symbol, bin, volume, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) = 1 AS point_of_control FROM y""")
def volume_profile(spark: SparkSession, d: str) -> DataFrame:
    """Traded volume in 24 price bins of each symbol, and the bin with most."""
    from marketloom.sources.tables import trades

    t = trades(spark, d)
    r = t.groupBy("symbol").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    b = F.least(F.lit(23), F.floor(F.try_divide(24 * (F.col("price") - F.col("lo")), F.col("hi") - F.col("lo")))).cast("long")
    y = t.join(r, "symbol").groupBy("symbol", b.alias("bin")).agg(F.sum("quantity").alias("volume"))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "bin")) == 1
    return y.select("symbol", "bin", "volume", first.alias("point_of_control"))


@query("corporate_action_adjust", f"""{BARS}, a AS (SELECT *, CASE WHEN symbol % 3 = 0 AND month(date) = 6 THEN 0.9 WHEN symbol % 5 = 0 AND month(date) = 3 THEN 0.5 ELSE 1.0 END AS factor FROM bars)
SELECT symbol, date, round(close * exp(coalesce(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 9) AS adjusted FROM a""", dates=("date",))
def corporate_action_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Closes times the factors of all later actions: a running product from the newest bar back."""
    f = F.when((F.col("symbol") % 3 == 0) & (F.month("date") == 6), 0.9).when((F.col("symbol") % 5 == 0) & (F.month("date") == 3), 0.5).otherwise(1.0)
    later = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    b = bars(spark, d).withColumn("factor", f)
    return b.select(*KEY, F.round(F.col("close") * F.exp(F.coalesce(F.sum(F.log("factor")).over(later), F.lit(0.0))), 9).alias("adjusted"))


_MIN = """x AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY ALL)"""


@query("tumbling_bars", f"WITH {_MIN} SELECT user_id, bucket, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM x", dates=("bucket",))
def tumbling_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of fixed length; the batch twin of the streaming builder."""
    from marketloom.streaming.bars import tumbling

    b = tumbling(load(spark, d, "events"), "6 hours")
    return b.select("user_id", "bucket", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "n")


@query("gapfill_locf", """WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY ALL), r AS (SELECT user_id, min(day) AS a, max(day) AS z FROM b GROUP BY 1),
g AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM r), j AS (SELECT g.user_id, g.day, close FROM g LEFT JOIN b USING (user_id, day))
SELECT user_id, day, round(last_value(close IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day), 6) AS close, CASE WHEN close IS NULL THEN 'filled' ELSE 'traded' END AS source FROM j""", dates=("day",))
def gapfill_locf(spark: SparkSession, d: str) -> DataFrame:
    """A row for every day between a key's first and last, missing ones filled with the last value."""
    e = load(spark, d, "events")
    b = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    until = F.coalesce(F.date_sub(F.lead("day").over(series("user_id", "day")), 1), F.col("day"))
    # Each row is repeated over the gap behind it, so no calendar is joined.
    filled = b.withColumn("until", until).select("user_id", "close", F.col("day").alias("own"), F.explode(F.sequence("day", "until")).alias("day"))
    return filled.select("user_id", "day", F.round("close", 6).alias("close"), F.when(F.col("day") == F.col("own"), "traded").otherwise("filled").alias("source"))

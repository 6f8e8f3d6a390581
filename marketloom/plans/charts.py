"""The chart library: indicators of one series, defined once as expressions over a series' rows.

A definition is SQL text that Spark and DuckDB read alike; all windows of a query
share one shuffle by symbol. What needs a state from bar to bar is in
``operators.recursive``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators import recursive
from marketloom.plans.catalog import query
from marketloom.plans.risk import r6
from marketloom.sources.tables import SQL_BARS, bars, trades

SERIES = "PARTITION BY symbol ORDER BY date"


def last(n: int) -> str:
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SERIES})"


def roll(fn: str, x: str, n: int) -> str:
    """An aggregate of the last ``n`` values, null until there are so many."""
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN {fn}({x}) OVER {last(n)} END"


def weighted(x: str, weights: list[float]) -> str:
    """The mean of the last values, of which the first weight is the latest's."""
    return "(" + " + ".join(f"{w!r} * {lag(x, k) if k else x}" for k, w in enumerate(weights)) + f") / {sum(weights)!r}"


def wma(x: str, n: int) -> str:
    return weighted(x, [float(n - k) for k in range(n)])


def since(x: str, extreme: str, n: int) -> str:
    """How many bars ago ``x`` was at its extreme, the latest time."""
    return "CASE " + " ".join(f"WHEN {lag(x, k) if k else x} = {extreme} THEN {k}" for k in range(n)) + " END"


def steps(*layers: dict[str, str]) -> str:
    """The definitions as nested selects over bars."""
    sql = "bars"
    for layer in layers:
        sql = f"(SELECT *, {', '.join(f'{x} AS {n}' for n, x in layer.items())} FROM {sql})"
    return sql


def defined(df: DataFrame, *layers: dict[str, str]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({n: F.expr(x) for n, x in layer.items()})
    return df


def chart(name: str, columns: tuple[str, ...], *layers: dict[str, str], digits: int = 6):
    """Registers the ``columns`` of ``layers`` as a query of its own."""
    sql = f"WITH {SQL_BARS} SELECT symbol, date, {', '.join(f'round({c}, {digits}) AS {c}' for c in columns)} FROM {steps(*layers)}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return defined(bars(spark, d), *layers).select("symbol", "date", *[F.round(c, digits).alias(c) for c in columns])

    run.__name__ = name
    query(name, sql, dates=("date",))(run)


BASE = {
    "prev": lag("close"), "hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4", "range": "high - low",
    "p_high": lag("high"), "p_low": lag("low"), "p_volume": lag("volume"),
}
STEP = {
    "step": "close - prev", "tr": "coalesce(greatest(high - low, abs(high - prev), abs(low - prev)), high - low)", "log_step": "ln(close / nullif(prev, 0))",
    "flow": "CASE WHEN high > low THEN (close - low - (high - close)) / nullif(high - low, 0) ELSE 0.0 END", "weight": "greatest(1.0, volume)",
}

_gauss = [2.718281828459045 ** (-((8 - k - 0.85 * 8) ** 2) / (2 * 1.5**2)) for k in range(9)]
chart(
    "chart_means", ("sma20", "wma20", "hma16", "alma9", "twap20", "vwap20", "vwap_up", "ribbon10", "ribbon30", "jma"), BASE, STEP,
    {
        "sma20": roll("avg", "close", 20), "wma20": wma("close", 20), "hull": f"2 * {wma('close', 8)} - {wma('close', 16)}", "alma9": weighted("close", _gauss), "twap20": roll("avg", "ohlc4", 20),
        "vwap20": f"sum(hlc3 * weight) OVER {last(20)} / sum(weight) OVER {last(20)}", "vwap_square": f"sum(hlc3 * hlc3 * weight) OVER {last(20)} / sum(weight) OVER {last(20)}",
        "ribbon10": roll("avg", "close", 10), "ribbon30": roll("avg", "close", 30),
    },
    {"hma16": wma("hull", 4), "vwap_up": "vwap20 + 2 * sqrt(greatest(0.0, vwap_square - vwap20 * vwap20))"}, {"jma": "(alma9 + hma16) / 2"}, digits=5,
)

_HALF = {f"mid{n}": f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2" for n in (9, 26, 52)}
chart(
    "chart_bands", ("donchian_up", "donchian_low", "envelope_up", "bb_pct_b", "bb_width", "bb_upper1", "bbtrend", "tenkan", "kijun", "span_a", "span_b", "stderr_up"), BASE, STEP,
    {
        "donchian_up": roll("max", "high", 20), "donchian_low": roll("min", "low", 20), "m20": roll("avg", "close", 20), "s20": roll("stddev_pop", "close", 20), "m50": roll("avg", "close", 50), "s50": roll("stddev_pop", "close", 50),
        "k": f"CAST(row_number() OVER ({SERIES}) AS DOUBLE)", **_HALF,
    },
    {
        "envelope_up": "m20 * 1.025", "bb_pct_b": "(close - (m20 - 2 * s20)) / nullif(4 * s20, 0)", "bb_width": "4 * s20 / m20 * 100", "bb_upper1": "m20 + s20",
        "bbtrend": "(abs((m20 - 2 * s20) - (m50 - 2 * s50)) - abs((m20 + 2 * s20) - (m50 + 2 * s50))) / m20 * 100", "tenkan": "mid9", "kijun": "mid26", "span_a": "(mid9 + mid26) / 2", "span_b": "mid52",
        "end20": f"m20 + regr_slope(close, k) OVER {last(20)} * 9.5",
    },
    {"stderr_up": "end20 + 2 * s20"}, digits=5,
)

chart(
    "chart_volume", ("cmf20", "adl", "pvt", "eom14", "net_volume", "up_volume", "rvol20", "adr_volume", "adr_bars", "ad_line", "volume_10"), BASE, STEP,
    {
        "money": "flow * volume", "turn": "CASE WHEN prev > 0 THEN step / prev * volume END", "ease": "(hl2 - " + lag("hl2") + ") / nullif(volume / 1e6 / greatest(1e-4, high - low), 0)",
        "up_bar": "CASE WHEN step >= 0 THEN 1.0 WHEN step < 0 THEN 0.0 END", "up_vol": "CASE WHEN step >= 0 THEN volume WHEN step < 0 THEN 0.0 END", "line": "step / greatest(1.0, high - low) * 100",
        "net_volume": "CASE WHEN close >= open THEN volume ELSE -volume END", "up_volume": "CASE WHEN close >= open THEN volume ELSE 0.0 END", "rvol20": f"volume / nullif({roll('avg', 'volume', 20)}, 0)", "volume_10": roll("avg", "volume", 10),
    },
    {
        "cmf20": f"CASE WHEN count(money) OVER {last(20)} = 20 THEN coalesce(sum(money) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0), 0) END", "adl": f"sum(money) OVER ({SERIES})", "pvt": f"sum(turn) OVER ({SERIES})",
        "eom14": roll("avg", "ease", 14), "ad_line": f"sum(line) OVER ({SERIES})", "ups": roll("sum", "up_vol", 14), "up_bars": roll("sum", "up_bar", 14), "all14": f"sum(CASE WHEN step IS NOT NULL THEN volume END) OVER {last(14)}",
    },
    {"adr_volume": "CASE WHEN all14 - ups > 0 THEN ups / nullif(all14 - ups, 0) WHEN ups > 0 THEN 3.0 ELSE CASE WHEN ups IS NOT NULL THEN 1.0 END END", "adr_bars": "CASE WHEN 14 - up_bars > 0 THEN up_bars / nullif(14 - up_bars, 0) WHEN up_bars > 0 THEN 3.0 END"}, digits=4,
)

chart(
    "chart_momentum", ("mom10", "roc9", "willr14", "cmo9", "ao", "dpo21", "coppock", "kst", "kst_signal", "correlation20", "slope14", "hv10", "stddev20", "seasonality", "performance60"), BASE, STEP,
    {
        "mom10": f"close - {lag('close', 10)}", "roc9": f"(close / nullif({lag('close', 9)}, 0) - 1) * 100", **{f"roc{n}": f"(close / nullif({lag('close', n)}, 0) - 1) * 100" for n in (10, 11, 14, 15, 20, 30)},
        "willr14": f"({roll('max', 'high', 14)} - close) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) * -100", "gains": roll("sum", "greatest(step, 0.0 * step)", 9), "moves": roll("sum", "abs(step)", 9),
        "fast": roll("avg", "hl2", 5), "slow": roll("avg", "hl2", 34), "m21": roll("avg", "close", 21), "k": f"CAST(row_number() OVER ({SERIES}) AS DOUBLE)", "hv10": f"({roll('stddev_pop', 'log_step', 10)}) * sqrt(252.0) * 100", "stddev20": roll("stddev_pop", "close", 20),
        "performance60": f"(close / nullif({lag('close', 59)}, 0) - 1) * 100", "change": "CASE WHEN prev > 0 THEN step / prev * 100 END",
    },
    {
        "cmo9": "coalesce((2 * gains - moves) / nullif(moves, 0), CASE WHEN moves IS NOT NULL THEN 0.0 END) * 100", "ao": "fast - slow", "dpo21": f"close - {lag('m21', 11)}", "rocs": "roc14 + roc11", "r1": roll("avg", "roc10", 10), "r2": roll("avg", "roc15", 10), "r3": roll("avg", "roc20", 10), "r4": roll("avg", "roc30", 15),
        "correlation20": f"CASE WHEN count(close) OVER {last(20)} = 20 THEN corr(close, k) OVER {last(20)} END", "slope14": f"CASE WHEN count(close) OVER {last(14)} = 14 THEN regr_slope(close, k) OVER {last(14)} END",
        "seasonality": "avg(change) OVER (PARTITION BY symbol, month(date) ORDER BY date)",
    },
    {"coppock": wma("rocs", 10), "kst": "r1 + 2 * r2 + 3 * r3 + 4 * r4"}, {"kst_signal": roll("avg", "kst", 9)}, digits=5,
)

_DEVIATION = " + ".join(f"abs({lag('hlc3', k) if k else 'hlc3'} - m20)" for k in range(20))
chart(
    "chart_oscillators", ("cci20", "bop14", "chop14", "aroon_up", "aroon_down", "aroon_osc", "vortex_up", "vortex_down", "ulcer14", "ultimate", "adr14", "rvgi10", "rvgi_signal"), BASE, STEP,
    {
        "m20": roll("avg", "hlc3", 20), "balance": "CASE WHEN high > low THEN (close - open) / nullif(high - low, 0) ELSE 0.0 END", "hh14": roll("max", "high", 14), "ll14": roll("min", "low", 14), "tr14": roll("sum", "tr", 14),
        "hh15": roll("max", "high", 15), "ll15": roll("min", "low", 15), "up_move": "abs(high - p_low)", "down_move": "abs(low - p_high)", "top14": roll("max", "close", 14), "adr14": roll("avg", "high - low", 14),
        "bought": "close - least(low, prev)", "true_range": "greatest(1e-6, greatest(high, prev) - least(low, prev))",
        "num": f"({weighted('(close - open)', [1.0, 2.0, 2.0, 1.0])})", "den": f"({weighted('(high - low)', [1.0, 2.0, 2.0, 1.0])})",
    },
    {
        "deviation": f"({_DEVIATION}) / 20", "bop14": roll("avg", "balance", 14), "chop14": "100 * log10(tr14 / nullif(hh14 - ll14, 0)) / log10(14.0)", "aroon_up": f"(14 - {since('high', 'hh15', 15)}) / 14e0 * 100", "aroon_down": f"(14 - {since('low', 'll15', 15)}) / 14e0 * 100",
        "vortex_up": f"({roll('sum', 'up_move', 14)}) / nullif(tr14, 0)", "vortex_down": f"({roll('sum', 'down_move', 14)}) / nullif(tr14, 0)", "fall": "power((close - top14) / nullif(top14, 0) * 100, 2)",
        **{f"u{n}": f"sum(bought) OVER {last(n)} / nullif(sum(true_range) OVER {last(n)}, 0)" for n in (7, 14, 28)}, "bars_bought": f"count(bought) OVER {last(28)}", "sn": roll("avg", "num", 10), "sd": roll("avg", "den", 10),
    },
    {
        "cci20": "CASE WHEN deviation > 0 THEN (hlc3 - m20) / nullif(0.015 * deviation, 0) WHEN deviation = 0 THEN 0.0 END", "aroon_osc": "aroon_up - aroon_down", "mean_fall": roll("avg", "fall", 14), "ultimate": "CASE WHEN bars_bought = 28 THEN 100 * (4 * u7 + 2 * u14 + u28) / 7 END", "rvgi10": "sn / nullif(sd, 0)",
    },
    {"ulcer14": "sqrt(greatest(0.0 * mean_fall, mean_fall))", "rvgi_signal": wma("rvgi10", 4)}, digits=5,
)

_PIVOT = {"h20": f"max(high) OVER ({SERIES} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "l20": f"min(low) OVER ({SERIES} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"}
chart(
    "chart_pivots", ("pivot_point", "r1", "s1", "r2", "s2", "fib_r1", "fib_s1", "woodie", "camarilla_r3", "camarilla_s3"), BASE, _PIVOT, {"pivot_point": "(h20 + l20 + prev) / 3", "width": "h20 - l20"},
    {
        "r1": "2 * pivot_point - l20", "s1": "2 * pivot_point - h20", "r2": "pivot_point + width", "s2": "pivot_point - width", "fib_r1": "pivot_point + 0.382 * width", "fib_s1": "pivot_point - 0.382 * width", "woodie": "(h20 + l20 + 2 * open) / 4",
        "camarilla_r3": "prev + width * 1.1 / 4", "camarilla_s3": "prev - width * 1.1 / 4",
    },
)

chart(
    "batch_levels", ("ma200", "volume_ma5", "volume_ma20", "volume_ratio", "rsi7", "rsi21", "volatility60", "volatility252", "momentum60", "momentum120", "momentum252", "floor_streak"), BASE, STEP,
    {
        "bars_all": "count(*) OVER (PARTITION BY symbol)", "n": f"row_number() OVER ({SERIES})", "volume_ma5": roll("avg", "volume", 5), "volume_ma20": roll("avg", "volume", 20), "change": "close / nullif(prev, 0) - 1", "gain": "CASE WHEN step > 0 THEN step WHEN step <= 0 THEN 0.0 END", "loss": "CASE WHEN step < 0 THEN -step WHEN step >= 0 THEN 0.0 END",
        **{f"momentum{n}": f"close / nullif({lag('close', n)}, 0) - 1" for n in (60, 120, 252)},
    },
    {
        "ma200": f"CASE WHEN n >= least(200, bars_all) THEN avg(close) OVER {last(200)} END", "volume_ratio": "volume / nullif(volume_ma20, 0)", **{f"rsi{n}": f"100 - 100 / (1 + ({roll('avg', 'gain', n)}) / nullif({roll('avg', 'loss', n)}, 0))" for n in (7, 21)},
        **{f"volatility{n}": f"({roll('stddev_samp', 'change', n)}) * sqrt(252.0) * 100" for n in (60, 252)}, "not_floor": "CASE WHEN change <= -0.069 THEN 0 ELSE 1 END",
    },
    {"island": f"sum(not_floor) OVER ({SERIES})"}, {"floor_streak": "CAST(sum(1 - not_floor) OVER (PARTITION BY symbol, island ORDER BY date) AS DOUBLE)"}, digits=5,
)

def sql_seeded(name: str, x: str, n: int, alpha: str, of: str = "b0") -> str:
    """The recursion of ``seeded_mean`` over column ``x`` of ``of``, as ``name`` (symbol, date, x)."""
    return f"""{name}_v AS (SELECT symbol, date, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM {of} WHERE {x} IS NOT NULL),
{name}_s AS (SELECT *, avg(x) OVER (PARTITION BY symbol ORDER BY k ROWS {n - 1} PRECEDING) AS m FROM {name}_v),
{name}_r AS (SELECT symbol, date, k, m AS x FROM {name}_s WHERE k = {n} UNION ALL SELECT v.symbol, v.date, v.k, e.x + {alpha} * (v.x - e.x) FROM {name}_r e JOIN {name}_v v ON v.symbol = e.symbol AND v.k = e.k + 1),
{name} AS (SELECT symbol, date, x FROM {name}_r)"""


def sql_ema(name: str, x: str, n: int, of: str = "b0") -> str:
    return sql_seeded(name, x, n, f"2.0 / {n + 1}", of)


_B0 = f"""{SQL_BARS}, b0 AS (SELECT *, step * volume AS force, close + coalesce(close - {lag('close', 9)}, 0) AS ahead, sum(flow * volume) OVER ({SERIES}) AS adl, abs(step) AS size FROM {steps(BASE, STEP)})"""


_MEANS = ", ".join([
    sql_ema("e20", "close", 20), sql_ema("e20b", "x", 20, "e20"), sql_ema("e20c", "x", 20, "e20b"), sql_seeded("s14", "close", 14, "1.0 / 14"), sql_ema("z20", "ahead", 20), sql_seeded("a14", "tr", 14, "1.0 / 14"), sql_ema("f13", "force", 13), sql_ema("e13", "close", 13),
    sql_ema("c3", "adl", 3), sql_ema("c10", "adl", 10), sql_ema("e12", "close", 12), sql_ema("e26", "close", 26), sql_ema("t1", "close", 15), sql_ema("t2", "x", 15, "t1"), sql_ema("t3", "x", 15, "t2"), sql_ema("m1", "step", 25), sql_ema("m2", "x", 13, "m1"), sql_ema("n1", "size", 25), sql_ema("n2", "x", 13, "n1"),
    sql_ema("w1", "range", 9), sql_ema("w2", "x", 9, "w1"),
])
_JOINED = " ".join(f"LEFT JOIN {n} ON {n}.symbol = b.symbol AND {n}.date = b.date" for n in ("e20", "e20b", "e20c", "s14", "z20", "a14", "f13", "e13", "c3", "c10", "e12", "e26", "t3", "m2", "n2", "w1", "w2"))


@query("chart_smoothed", f"""WITH RECURSIVE {_B0}, {_MEANS}, j AS (SELECT b.symbol, b.date, e20.x AS ema20, s14.x AS smma14, 2 * e20.x - e20b.x AS dema20, 3 * (e20.x - e20b.x) + e20c.x AS tema20, z20.x AS zlema20, a14.x AS atr14, f13.x AS efi13, b.high + b.low - 2 * e13.x AS bull_bear13,
  c3.x - c10.x AS chaikin, (e12.x - e26.x) / e26.x * 100 AS ppo, t3.x AS triple, 100 * m2.x / n2.x AS tsi, w1.x / w2.x AS ratio FROM b0 b {_JOINED})
SELECT symbol, date, round(ema20, 5) AS ema20, round(smma14, 5) AS smma14, round(dema20, 5) AS dema20, round(tema20, 5) AS tema20, round(zlema20, 5) AS zlema20, round(atr14, 5) AS atr14, round(ema20 + 2 * atr14, 5) AS keltner_up, round(efi13, 3) AS efi13, round(bull_bear13, 5) AS bull_bear13, round(chaikin, 4) AS chaikin, round(ppo, 5) AS ppo,
  round((triple / {lag('triple')} - 1) * 100, 5) AS trix, round(tsi, 5) AS tsi, round({roll('sum', 'ratio', 25)}, 5) AS mass FROM j""", dates=("date",))
def chart_smoothed(spark: SparkSession, d: str) -> DataFrame:
    s = recursive.smoothed(bars(spark, d), "symbol", "date").withColumn("keltner_up", F.col("ema20") + 2 * F.col("atr14"))
    digits = {"efi13": 3, "chaikin": 4}
    names = ("ema20", "smma14", "dema20", "tema20", "zlema20", "atr14", "keltner_up", "efi13", "bull_bear13", "chaikin", "ppo", "trix", "tsi", "mass")
    return s.select("symbol", "date", *[F.round(n, digits.get(n, 5)).alias(n) for n in names])


def _first(n: int) -> str:
    return f"2.0 / {n + 1}"


@query("batch_exponential", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, close, close / {lag('close')} - 1 AS c, row_number() OVER ({SERIES}) AS k FROM bars),
e AS (SELECT symbol, date, k, {", ".join(f"close AS ema{n}" for n in (5, 12, 26, 200))}, CAST(NULL AS DOUBLE) AS m20, CAST(NULL AS DOUBLE) AS q20, 1.0::DOUBLE AS w20, CAST(NULL AS DOUBLE) AS m60, CAST(NULL AS DOUBLE) AS q60, 1.0::DOUBLE AS w60 FROM r WHERE k = 1
UNION ALL SELECT r.symbol, r.date, r.k, {", ".join(f"e.ema{n} + {_first(n)} * (r.close - e.ema{n})" for n in (5, 12, 26, 200))},
  {", ".join(f"coalesce(e.m{n} + {_first(n)} * (r.c - e.m{n}), r.c), coalesce(e.q{n} + {_first(n)} * (r.c * r.c - e.q{n}), r.c * r.c), CASE WHEN e.m{n} IS NULL THEN 1.0 ELSE (1 - {_first(n)}) ** 2 * e.w{n} + ({_first(n)}) ** 2 END" for n in (20, 60))} FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k + 1)
SELECT symbol, date, {", ".join(f"round(ema{n}, 5) AS ema{n}" for n in (5, 12, 26, 200))}, {", ".join(f"round(sqrt(greatest(0, q{n} - m{n} * m{n}) / nullif(1 - w{n}, 0)) * sqrt(252) * 100, 4) AS volatility_ewma{n}" for n in (20, 60))} FROM e""", dates=("date",))
def batch_exponential(spark: SparkSession, d: str) -> DataFrame:
    s = recursive.first_seeded(bars(spark, d), "symbol", "date")
    return s.select("symbol", "date", *[F.round(f"ema{n}", 5).alias(f"ema{n}") for n in (5, 12, 26, 200)], *[F.round(f"volatility_ewma{n}", 4).alias(f"volatility_ewma{n}") for n in (20, 60)])


@query("chart_adaptive", f"""WITH RECURSIVE {SQL_BARS}, r AS (SELECT symbol, date, close, volume, (high + low) / 2 AS mid, {roll('max', '((high + low) / 2)', 9)} AS top, {roll('min', '((high + low) / 2)', 9)} AS bottom, row_number() OVER ({SERIES}) AS k FROM bars),
x AS (SELECT *, CASE WHEN top > bottom THEN ((mid - bottom) / nullif(top - bottom, 0) - 0.5) * 2 WHEN top = bottom THEN 0.0 END AS raw FROM r),
e AS (SELECT symbol, date, k, close, volume, close AS mg, 0.0::DOUBLE AS held, 0.0::DOUBLE AS fish, 1000.0::DOUBLE AS nvi, 1000.0::DOUBLE AS pvi FROM x WHERE k = 1
UNION ALL SELECT x.symbol, x.date, x.k, x.close, x.volume, e.mg + (x.close - e.mg) / (14 * least(4, greatest(0.25, x.close / e.mg)) ** 4),
  CASE WHEN x.k >= 9 THEN greatest(-0.999, least(0.999, 0.33 * x.raw + 0.67 * e.held)) ELSE 0 END,
  CASE WHEN x.k >= 9 THEN 0.5 * ln((1 + greatest(-0.999, least(0.999, 0.33 * x.raw + 0.67 * e.held))) / (1 - greatest(-0.999, least(0.999, 0.33 * x.raw + 0.67 * e.held)))) + 0.5 * e.fish ELSE 0 END,
  e.nvi * CASE WHEN x.volume < e.volume THEN x.close / e.close ELSE 1 END, e.pvi * CASE WHEN x.volume > e.volume THEN x.close / e.close ELSE 1 END FROM e JOIN x ON x.symbol = e.symbol AND x.k = e.k + 1)
SELECT symbol, date, CASE WHEN abs(mg) < 1e12 THEN round(mg, 4) END AS mcginley14, CASE WHEN k >= 9 THEN round(fish, 6) END AS fisher9, round(nvi, 4) AS nvi, round(pvi, 4) AS pvi FROM e""", dates=("date",))
def chart_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Means and indices with a state; a mean that ran away from jumps of the series is null."""
    s = recursive.adaptive(bars(spark, d), "symbol", "date")
    return s.select("symbol", "date", F.when(F.abs("mcginley14") < 1e12, F.round("mcginley14", 4)).alias("mcginley14"), r6("fisher9").alias("fisher9"), F.round("nvi", 4).alias("nvi"), F.round("pvi", 4).alias("pvi"))


_T3 = 0.7
_TRAILS = f"""n AS (SELECT symbol, date, high, low, close, volume, (high + low + close) / 3 AS typical, close - {lag('close')} AS step, row_number() OVER ({SERIES}) AS k, {lag('low')} AS l1, {lag('low', 2)} AS l2, {lag('high')} AS h1, {lag('high', 2)} AS h2,
  abs(close - {lag('close', 14)}) AS far, lead(close) OVER ({SERIES}) AS next FROM bars),
ps AS (SELECT symbol, 2::BIGINT AS k, CASE WHEN next >= close THEN 1 ELSE -1 END AS side, 0.02::DOUBLE AS pace, CASE WHEN next >= close THEN high ELSE -low END AS extreme, CASE WHEN next >= close THEN low ELSE -high END AS stop FROM n WHERE k = 1 AND next IS NOT NULL
UNION ALL SELECT symbol, k + 1, CASE WHEN hit THEN -side ELSE side END, CASE WHEN hit THEN 0.02 ELSE faster END, CASE WHEN hit THEN -worst ELSE ahead END, CASE WHEN hit THEN -extreme ELSE least(stop + faster * (ahead - stop), w1, w2) END
  FROM (SELECT *, worst < stop AS hit, greatest(extreme, best) AS ahead, CASE WHEN best > extreme THEN least(0.2, pace + 0.02) ELSE pace END AS faster
    FROM (SELECT ps.*, CASE WHEN side > 0 THEN high ELSE -low END AS best, CASE WHEN side > 0 THEN low ELSE -high END AS worst, CASE WHEN ps.k >= 3 THEN CASE WHEN side > 0 THEN l1 ELSE -h1 END END AS w1, CASE WHEN ps.k >= 3 THEN CASE WHEN side > 0 THEN l2 ELSE -h2 END END AS w2 FROM ps JOIN n ON n.symbol = ps.symbol AND n.k = ps.k))),
sh AS (SELECT *, coalesce(far / nullif(sum(abs(step)) OVER {last(14)}, 0), 0) * 2 / 15 AS share FROM n),
vi AS (SELECT symbol, k, close AS x FROM sh WHERE k = 15 UNION ALL SELECT sh.symbol, sh.k, vi.x + sh.share * (sh.close - vi.x) FROM vi JOIN sh ON sh.symbol = vi.symbol AND sh.k = vi.k + 1),
tr AS (SELECT *, CASE WHEN k = 1 OR typical > {lag('typical')} THEN 1 ELSE -1 END AS trend FROM n),
fo AS (SELECT symbol, date, CASE WHEN k > 1 THEN volume * trend * CASE WHEN trend = {lag('trend')} THEN 1.4 ELSE 0.8 END * greatest(0.0001, high - low) / greatest(1, close) * 100 END AS force FROM tr),
{sql_ema("k34", "force", 34, "fo")}, {sql_ema("k55", "force", 55, "fo")}, kl AS (SELECT symbol, date, k34.x - k55.x AS x FROM k34 JOIN k55 USING (symbol, date)), {sql_ema("ks", "x", 13, "kl")},
{", ".join(sql_ema(f"t{i}", "close" if i == 1 else "x", 8, "bars" if i == 1 else f"t{i - 1}") for i in range(1, 7))},
g0 AS (SELECT symbol, date, greatest(step, 0) AS up, greatest(-step, 0) AS down FROM n WHERE k > 1), {sql_seeded("gu", "up", 14, "1.0 / 14", "g0")}, {sql_seeded("gd", "down", 14, "1.0 / 14", "g0")},
rs AS (SELECT symbol, date, CASE WHEN gd.x = 0 THEN 100 ELSE 100 - 100 / (1 + gu.x / nullif(gd.x, 0)) END AS rsi FROM gu JOIN gd USING (symbol, date)),
hl AS (SELECT *, {roll('max', 'rsi', 14)} AS top, {roll('min', 'rsi', 14)} AS bottom FROM rs), rw AS (SELECT *, CASE WHEN top > bottom THEN (rsi - bottom) / nullif(top - bottom, 0) * 100 WHEN top = bottom THEN 50.0 END AS raw FROM hl),
kk AS (SELECT *, {roll('avg', 'raw', 3)} AS fast FROM rw), sr AS (SELECT *, {roll('avg', 'fast', 3)} AS slow FROM kk)"""


@query("chart_trailing", f"""WITH RECURSIVE {SQL_BARS}, {_TRAILS}
SELECT n.symbol, n.date, round(ps.stop * ps.side, 5) AS psar, round(vi.x, 5) AS vidya14, round(-({_T3**3!r}) * t6.x + {3 * _T3**2 * (1 + _T3)!r} * t5.x - {3 * _T3 * (1 + _T3) ** 2!r} * t4.x + {(1 + _T3) ** 3!r} * t3.x, 4) AS t3, round(kl.x, 3) AS klinger, round(ks.x, 3) AS klinger_signal, round(sr.fast, 4) AS stoch_rsi_k, round(sr.slow, 4) AS stoch_rsi_d
FROM n LEFT JOIN ps ON ps.symbol = n.symbol AND ps.k = n.k LEFT JOIN vi ON vi.symbol = n.symbol AND vi.k = n.k {" ".join(f"LEFT JOIN {t} ON {t}.symbol = n.symbol AND {t}.date = n.date" for t in ("t3", "t4", "t5", "t6", "kl", "ks", "sr"))}""", dates=("date",))
def chart_trailing(spark: SparkSession, d: str) -> DataFrame:
    """A trailing stop, adaptive and smoothed means, and the oscillators of volume force and relative strength."""
    s = recursive.trailing(bars(spark, d), "symbol", "date")
    digits = {"klinger": 3, "klinger_signal": 3, "psar": 5, "vidya14": 5}
    return s.select("symbol", "date", *[F.round(n, digits.get(n, 4)).alias(n) for n in ("psar", "vidya14", "t3", "klinger", "klinger_signal", "stoch_rsi_k", "stoch_rsi_d")])


def rank_correlation(x: str, n: int) -> str:
    """100 times the rank correlation of the last ``n`` values with their order; equal values share the mean of their ranks."""
    values = [lag(x, k) if k else x for k in range(n)]
    ranks = [" + ".join(f"CASE WHEN {b} > {a} THEN 1.0 WHEN {b} = {a} THEN 0.5 ELSE 0.0 END" for j, b in enumerate(values) if j != k) for k, a in enumerate(values)]
    squares = " + ".join(f"power({k} - ({r}), 2)" for k, r in enumerate(ranks))
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN (1 - 6 * ({squares}) / {n * (n * n - 1)}e0) * 100 END"


chart("chart_rank_correlation", ("rci5", "rci9"), {"rci5": rank_correlation("close", 5), "rci9": rank_correlation("close", 9)}, digits=5)


@query("value_area", f"""WITH {SQL_BARS}, r AS (SELECT symbol, min(price) AS lo, max(price) AS hi FROM trades GROUP BY symbol), y AS (SELECT symbol, CAST(least(23, floor(24 * (price - lo) / nullif(hi - lo, 0))) AS BIGINT) AS bin, sum(quantity) AS v FROM trades JOIN r USING (symbol) GROUP BY ALL),
c AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY v DESC, bin) - v AS before, sum(v) OVER (PARTITION BY symbol) AS total FROM y)
SELECT symbol, min(bin) AS lowest, max(bin) AS highest, count(*) AS bins, round(sum(v) / max(total), 6) AS share FROM c WHERE before < 0.7 * total GROUP BY symbol""")
def value_area(spark: SparkSession, d: str) -> DataFrame:
    """The fullest price bins that hold seven tenths of a symbol's volume."""
    t = trades(spark, d)
    r = t.groupBy("symbol").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    b = F.least(F.lit(23), F.floor(F.try_divide(24 * (F.col("price") - F.col("lo")), F.col("hi") - F.col("lo")))).cast("long")
    y = t.join(r, "symbol").groupBy("symbol", b.alias("bin")).agg(F.sum("quantity").alias("v"))
    w = Window.partitionBy("symbol")
    c = y.withColumns({"before": F.sum("v").over(w.orderBy(F.desc("v"), "bin")) - F.col("v"), "total": F.sum("v").over(w)})
    return c.filter("before < 0.7 * total").groupBy("symbol").agg(F.min("bin").alias("lowest"), F.max("bin").alias("highest"), F.count(F.lit(1)).alias("bins"), r6(F.sum("v") / F.max("total")).alias("share"))

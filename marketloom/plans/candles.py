"""Candle patterns, as families of mirror images.

Turned upside down (prices negated, highs and lows changed over), a rising candle is a
falling one, a hammer a shooting star, a rising window a falling one. So each family is
described once, for one of the two, and read from the bars and from their reflection.
Descriptions are built from the parts of a candle (``Candle``) and from how two candles
lie to each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import recursive
from marketloom.plans.catalog import query
from marketloom.plans.charts import defined, lag, sql_ema, steps
from marketloom.sources.tables import SQL_BARS, bars

#: The smallest step of prices; no candle counts as shorter.
TICK = 0.01
#: Bars back that some pattern looks at.
BACK = (1, 2, 4)
#: Shares of a candle's length, unless they are of another's body.
DOJI, DOJI_BEFORE = 0.1, 0.12
LONG_WICK, SHORT_WICK, SHADOW = 0.65, 0.12, 0.62
WICK_OF_BODY, CAP_OF_BODY = 2, 0.5
ENGULFS, HARAMI = 1.05, 0.7
STAR_FIRST, STAR_MIDDLE = 0.4, 0.45
MARUBOZU, SOLDIER, SPINNING, KICKING = 0.85, 0.5, 0.3, 0.65
LEVEL, NECK = 0.06, 0.1


@dataclass(frozen=True)
class Candle:
    """Parts of one bar as SQL: ``top`` and ``bottom`` are the wicks, ``length`` is from high to low."""

    open: str
    high: str
    low: str
    close: str

    @property
    def body(self) -> str:
        return f"abs({self.close} - {self.open})"

    @property
    def length(self) -> str:
        return f"greatest({TICK}, {self.high} - {self.low})"

    @property
    def top(self) -> str:
        return f"({self.high} - greatest({self.open}, {self.close}))"

    @property
    def bottom(self) -> str:
        return f"(least({self.open}, {self.close}) - {self.low})"

    @property
    def middle(self) -> str:
        return f"(({self.open} + {self.close}) / 2)"

    @property
    def rises(self) -> str:
        return f"{self.close} > {self.open}"

    @property
    def falls(self) -> str:
        return f"{self.close} < {self.open}"

    def tiny(self, share: float) -> str:
        """The body is next to nothing."""
        return f"{self.body} <= {self.length} * {share}"

    def full(self, share: float) -> str:
        return f"{self.body} >= {self.length} * {share}"

    def within_body(self, other: Candle) -> str:
        """All of it lies in the body of a candle that fell."""
        return f"{self.high} <= {other.open} AND {self.low} >= {other.close}"

    def above(self, other: Candle) -> str:
        """A gap parts it from a lower one."""
        return f"{self.low} > {other.high}"


@dataclass(frozen=True)
class View:
    """The bars as they are, or their reflection."""

    upside_down: bool

    def candle(self, back: int) -> Candle:
        o, h, l, c = (f"{n}{back}" if back else {"o": "open", "h": "high", "l": "low", "c": "close"}[n] for n in "ohlc")
        return Candle(f"(-{o})", f"(-{l})", f"(-{h})", f"(-{c})") if self.upside_down else Candle(o, h, l, c)

    @property
    def sinks(self) -> str:
        """The close lies below its exponential mean, or where there is none yet, below the close two bars before."""
        sign = "-" if self.upside_down else ""
        return f"{sign}close < {sign}coalesce(ema14, c2)"


Family = Callable[[View, Candle, Candle, Candle], list[str]]
FAMILIES: dict[tuple[str, str], Family] = {}


def family(name: str, mirrored: str):
    """Registers conditions that must all hold: for ``name`` on the bars, for ``mirrored`` on their reflection."""

    def put(fn: Family) -> Family:
        FAMILIES[name, mirrored] = fn
        return fn

    return put


# One candle.
family("DRAGONFLY_DOJI", "GRAVESTONE_DOJI")(lambda v, x, y, z: [x.tiny(DOJI), f"{x.bottom} >= {x.length} * {LONG_WICK}", f"{x.top} <= {x.length} * {SHORT_WICK}"])
family("MARUBOZU_WHITE", "MARUBOZU_BLACK")(lambda v, x, y, z: [x.rises, x.full(MARUBOZU)])
family("SPINNING_WHITE", "SPINNING_BLACK")(lambda v, x, y, z: [x.rises, x.tiny(SPINNING), f"least({x.top}, {x.bottom}) >= {x.body}"])
family("LONG_LOWER_SHADOW", "LONG_UPPER_SHADOW")(lambda v, x, y, z: [f"{x.bottom} >= {x.length} * {SHADOW}"])


def _hangs(x: Candle, long: str, short: str) -> list[str]:
    """A body with one long wick and hardly another."""
    return [f"{x.body} > 0", f"{long} >= {x.body} * {WICK_OF_BODY}", f"{short} <= {x.body} * {CAP_OF_BODY}"]


family("HAMMER", "SHOOTING_STAR")(lambda v, x, y, z: [v.sinks, *_hangs(x, x.bottom, x.top)])
family("INVERTED_HAMMER", "HANGING_MAN")(lambda v, x, y, z: [v.sinks, *_hangs(x, x.top, x.bottom)])

# Two candles: x after y.
family("RISING_WINDOW", "FALLING_WINDOW")(lambda v, x, y, z: [x.above(y)])
family("DOJI_STAR_BULL", "DOJI_STAR_BEAR")(lambda v, x, y, z: [y.falls, x.tiny(DOJI), f"{x.high} <= {y.close}"])
family("HARAMI_CROSS_BULL", "HARAMI_CROSS_BEAR")(lambda v, x, y, z: [y.falls, x.tiny(DOJI), x.within_body(y)])


def _turns(x: Candle, y: Candle) -> list[str]:
    """A fall, then a rise."""
    return [y.falls, x.rises]


family("HARAMI_BULL", "HARAMI_BEAR")(lambda v, x, y, z: [*_turns(x, y), x.within_body(y), f"{x.body} < {y.body} * {HARAMI}"])
family("ENGULFING_BULL", "ENGULFING_BEAR")(lambda v, x, y, z: [*_turns(x, y), f"{x.open} <= {y.close}", f"{x.close} >= {y.open}", f"{x.body} > {y.body} * {ENGULFS}"])
family("KICKING_BULL", "KICKING_BEAR")(lambda v, x, y, z: [*_turns(x, y), f"{x.open} >= {y.open}", x.full(KICKING)])
family("PIERCING", "DARK_CLOUD")(lambda v, x, y, z: [*_turns(x, y), f"{x.open} < {y.low}", f"{x.close} > {y.middle}", f"{x.close} < {y.open}"])
family("TWEEZER_BOTTOM", "TWEEZER_TOP")(lambda v, x, y, z: [v.sinks, *_turns(x, y), f"abs({x.low} - {y.low}) <= {x.length} * {LEVEL}"])

# Three candles: x after y after z.
_recovers = lambda x, z: [z.falls, x.rises, f"{x.close} > {z.middle}"]
family("MORNING_STAR", "EVENING_STAR")(lambda v, x, y, z: [*_recovers(x, z), f"{z.body} > {x.length} * {STAR_FIRST}", f"{y.body} < {z.body} * {STAR_MIDDLE}"])
family("MORNING_DOJI", "EVENING_DOJI")(lambda v, x, y, z: [*_recovers(x, z), y.tiny(DOJI_BEFORE)])
family("ABANDONED_BABY_BULL", "ABANDONED_BABY_BEAR")(lambda v, x, y, z: [z.falls, y.tiny(DOJI_BEFORE), z.above(y), x.rises, x.above(y)])
family("3_WHITE_SOLDIERS", "3_BLACK_CROWS")(lambda v, x, y, z: [x.rises, y.rises, z.rises, f"{x.close} > {y.close}", f"{y.close} > {z.close}", f"{x.body} > {x.length} * {SOLDIER}"])
family("UPSIDE_TASUKI", "DOWNSIDE_TASUKI")(lambda v, x, y, z: [z.rises, y.rises, y.above(z), x.falls, f"{x.close} < {y.open}", f"{x.close} > {z.high}"])
family("TRISTAR_BULL", "TRISTAR_BEAR")(lambda v, x, y, z: [v.sinks, x.tiny(DOJI), y.tiny(DOJI_BEFORE), z.tiny(DOJI_BEFORE)])


@family("RISING_3", "FALLING_3")
def _pauses(v: View, x: Candle, y: Candle, z: Candle) -> list[str]:
    """A rise, a pause of falls, and a rise beyond the first."""
    first = v.candle(4)
    return [first.rises, z.falls, y.falls, x.rises, f"{x.close} > {first.close}"]


def patterns() -> dict[str, str]:
    """Each pattern's condition."""
    x, y = View(False).candle(0), View(False).candle(1)
    told = {"DOJI": [x.tiny(DOJI)], "ON_NECK": [*_turns(x, y), f"{x.open} < {y.low}", f"abs({x.close} - {y.low}) <= {x.length} * {NECK}"]}
    for names, fn in FAMILIES.items():
        for name, view in zip(names, (View(False), View(True)), strict=True):
            told[name] = fn(view, view.candle(0), view.candle(1), view.candle(2))
    return {name: " AND ".join(told[name]) for name in sorted(told)}


PATTERNS = patterns()
_LAGS = {f"{c[0]}{k}": lag(c, k) for k in BACK for c in ("open", "high", "low", "close")}


@query(
    "candle_patterns_all",
    f"""WITH RECURSIVE {SQL_BARS}, b0 AS (SELECT symbol, date, close FROM bars), {sql_ema("e14", "close", 14)}, j AS (SELECT bars.*, e14.x AS ema14 FROM bars LEFT JOIN e14 USING (symbol, date))
SELECT symbol, date, array_to_string(list_filter([{", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in PATTERNS.items())}], lambda x: x IS NOT NULL), ',') AS patterns FROM {steps(_LAGS).replace("FROM bars", "FROM j", 1)}""",
    dates=("date",),
)
def candle_patterns_all(spark: SparkSession, d: str) -> DataFrame:
    """All patterns of each bar, by name; the trend is the close against its exponential mean of 14."""
    b = bars(spark, d)
    mean = recursive.mean_of(b, "symbol", "date", "close", 14, "ema14", ["open", "high", "low"])
    x = defined(mean, _LAGS)
    return x.select("symbol", "date", F.concat_ws(",", *[F.when(F.expr(c), n) for n, c in PATTERNS.items()]).alias("patterns"))

"""Candle patterns on bars drawn for them, on their reflections, and counted on random bars."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.plans import candles

BARS = "symbol long, date int, open double, high double, low double, close double, ema14 double"
#: Bars (open, high, low, close) up to the one that shows the pattern; its mean before, for the trend.
DRAWN = {
    "HAMMER": [(50, 51, 49, 50)] * 4 + [(40, 41.2, 34, 42)],
    "ENGULFING_BULL": [(50, 51, 49, 50)] * 3 + [(50, 51, 44, 45), (44, 53, 43, 52)],
    "HARAMI_BULL": [(50, 51, 49, 50)] * 3 + [(50, 51, 39, 40), (43, 46, 42, 45)],
    "MORNING_STAR": [(50, 51, 49, 50)] * 2 + [(50, 51, 39, 40), (39, 40, 37, 38), (40, 49, 39, 48)],
    "PIERCING": [(50, 51, 49, 50)] * 3 + [(50, 51, 39, 40), (38, 48, 37, 47)],
    "MARUBOZU_WHITE": [(50, 51, 49, 50)] * 4 + [(50, 60, 50, 60)],
    "3_WHITE_SOLDIERS": [(50, 51, 49, 50)] * 2 + [(50, 54, 50, 53), (52, 57, 52, 56), (55, 60, 55, 59)],
    "ABANDONED_BABY_BULL": [(50, 51, 49, 50)] * 2 + [(50, 51, 44, 45), (40, 41, 39, 40), (43, 49, 42, 48)],
    "RISING_3": [(50, 56, 49, 55), (55, 56, 53, 54), (54, 55, 52, 53), (53, 54, 51, 52), (52, 58, 52, 57)],
    "UPSIDE_TASUKI": [(50, 51, 49, 50)] * 2 + [(50, 53, 49, 52), (55, 58, 54, 57), (56, 57, 53, 53.5)],
    "TRISTAR_BULL": [(50, 51, 49, 50)] * 2 + [(40, 42, 38, 40), (39, 41, 37, 39), (38, 40, 36, 38)],
}
MIRROR = {a: b for pair in candles.FAMILIES for a, b in (pair, pair[::-1])}


def found(spark, series):
    """Pattern names of the last bar of each of some series of bars."""
    rows = [(s, t, *map(float, b), 45.0) for s, bars in enumerate(series) for t, b in enumerate(bars)]
    frame = candles.defined(spark.createDataFrame(rows, BARS), candles._LAGS)
    names = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in candles.PATTERNS.items()]))
    last = frame.groupBy("symbol").agg(F.max_by(names, "date").alias("n"), F.collect_list(F.struct("date", names.alias("n"))).alias("each"))
    return {r["symbol"]: ({*r["n"]}, [x["n"] for x in sorted(r["each"])]) for r in last.collect()}


def reflected(bars):
    return [(90 - o, 90 - l, 90 - h, 90 - c) for o, h, l, c in bars]


def test_each_pattern_on_bars_drawn_for_it(spark):
    series = list(DRAWN.values()) + [reflected(b) for b in DRAWN.values()]
    got = found(spark, series)
    for k, name in enumerate(DRAWN):
        assert name in got[k][0], name
        assert MIRROR[name] in got[len(DRAWN) + k][0] and name not in got[len(DRAWN) + k][0]


def test_a_reflection_shows_the_mirrored_patterns(spark):
    rng = np.random.default_rng(6)
    series = []
    for _ in range(40):
        o, c = 45 + rng.integers(-4, 5, 30), 45 + rng.integers(-4, 5, 30)
        h, l = np.maximum(o, c) + rng.integers(0, 5, 30), np.minimum(o, c) - rng.integers(0, 5, 30)
        series.append(list(zip(o, h, l, c, strict=True)))
    got = found(spark, series + [reflected(b) for b in series])
    seen = set()
    for k in range(40):
        for names, mirrored in zip(got[k][1], got[40 + k][1], strict=True):
            assert {MIRROR.get(n, n) for n in names if n != "ON_NECK"} == {n for n in mirrored if n != "ON_NECK"}
            seen |= {*names}
    assert len(seen) >= 35


def test_there_are_44_patterns():
    assert len(candles.PATTERNS) == 44 and len(candles.FAMILIES) == 21
    assert candles.View(True).candle(0).open == "(-open)" and pytest.approx(0.01) == candles.TICK

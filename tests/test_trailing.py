"""The trailing stop and the adaptive mean against loops over one series at a time."""

from __future__ import annotations

import numpy as np

from marketloom.operators import recursive


def stops(bars, start=0.02, most=0.2):
    """Long and short written out."""
    out = [None]
    if len(bars) < 2:
        return out[: len(bars)]
    long = bars[1][2] >= bars[0][2]
    pace, extreme, at = start, bars[0][0 if long else 1], bars[0][1 if long else 0]
    for t in range(1, len(bars)):
        high, low, _ = bars[t]
        out.append(at)
        if (low < at) if long else (high > at):
            long, at, extreme, pace = not long, extreme, low if long else high, start
            continue
        if (high > extreme) if long else (low < extreme):
            extreme, pace = high if long else low, min(most, pace + start)
        at += pace * (extreme - at)
        if t >= 2:
            at = min(at, bars[t - 1][1], bars[t - 2][1]) if long else max(at, bars[t - 1][0], bars[t - 2][0])
    return out


def adapted(close, n=14):
    out, last = [None] * len(close), None
    for t in range(n, len(close)):
        steps = np.diff(close[t - n : t + 1])
        share = abs(steps.sum()) / np.abs(steps).sum() if np.abs(steps).sum() else 0.0
        last = close[t] if last is None else last + 2 / (n + 1) * share * (close[t] - last)
        out[t] = last
    return out


def test_stops_and_means_of_many_series(spark):
    rng = np.random.default_rng(5)
    series = []
    for n in (1, 2, 3, 16, 40, 90, 90):
        close = 50 * np.exp(np.cumsum(rng.standard_normal(n) * 0.05))
        series.append([(c * (1 + rng.random() * 0.03), c * (1 - rng.random() * 0.03), c) for c in close])
    series.append([(5.0, 5.0, 5.0)] * 30)
    rows = [(s, t, *map(float, b), 10.0) for s, bars in enumerate(series) for t, b in enumerate(bars)]
    got = {}
    for r in recursive.trailing(spark.createDataFrame(rows, "s long, t long, high double, low double, close double, volume double"), "s", "t").collect():
        got.setdefault(r["s"], {})[r["t"]] = r
    for s, bars in enumerate(series):
        for t, (stop, mean) in enumerate(zip(stops(bars), adapted([b[2] for b in bars]), strict=True)):
            r = got[s][t]
            assert (r["psar"] is None) == (stop is None) and (stop is None or abs(r["psar"] - stop) < 1e-9)
            assert (r["vidya14"] is None) == (mean is None) and (mean is None or abs(r["vidya14"] - mean) < 1e-9)
    assert got[5][89]["klinger"] is not None and 0 <= got[5][89]["stoch_rsi_d"] <= 100 and got[3][15]["klinger"] is None

"""Zigzags and shapes against plain loops, and shapes on points drawn for them."""

from __future__ import annotations

import numpy as np

from marketloom.operators import recursive
from marketloom.operators.shapes import matched
from marketloom.plans.shapes import SHAPES


def walked(bars, share):
    """Turning points by looking at one bar after the other."""
    out, price, at, way = [], bars[0][3], 0, 0
    for t, (_, high, low, _) in enumerate(bars[1:], 1):
        if way >= 0 and high > price:
            price, at, way = high, t, 1
        elif way <= 0 and low < price:
            price, at, way = low, t, -1
        elif way >= 0 and (price - low) / price >= share:
            out.append((at, price, way))
            price, at, way = low, t, -1
        elif way <= 0 and (high - price) / price >= share:
            out.append((at, price, way))
            price, at, way = high, t, 1
    return [*out, (at, price, way)]


def test_zigzag_by_a_plain_walk(spark):
    rng = np.random.default_rng(9)
    series = []
    for s in range(25):
        close = 100 * np.exp(np.cumsum(rng.standard_normal(rng.integers(1, 90)) * 0.03))
        series.append([(c, c * (1 + abs(rng.standard_normal()) * 0.01), c * (1 - abs(rng.standard_normal()) * 0.01), c) for c in close])
    series.append([(5.0, 5.0, 5.0, 5.0)] * 7)
    rows = [(s, t, float(h), float(l), float(c)) for s, bars in enumerate(series) for t, (_, h, l, c) in enumerate(bars)]
    got = {}
    for r in recursive.zigzag(spark.createDataFrame(rows, "s long, t long, high double, low double, close double"), "s", "t", 0.05).collect():
        got.setdefault(r["s"], []).append((r["point"], r["t"], r["price"], r["way"]))
    for s, bars in enumerate(series):
        assert [x[1:] for x in sorted(got[s])] == [(t, float(p), w) for t, p, w in walked(bars, 0.05)]


def flipped(drawn):
    return [200 - p for p in drawn]


def found(spark, drawn, way):
    """Shapes that begin with the first of some points, whose kinds take turns."""
    rows = [(1, k, f"d{k}", float(p), way * (-1) ** k) for k, p in enumerate(drawn)]
    frame = spark.createDataFrame(rows, "symbol long, point long, date string, price double, way int")
    return {r["shape"]: (r["last"], r["target"]) for r in matched(frame, "symbol", "point", SHAPES).collect() if r["first"] == "d0"}


def test_shapes_on_drawn_points(spark):
    drawn = {
        "DOUBLE_TOP": ([110, 100, 111], ("d2", 89.0)), "TRIPLE_TOP": ([110, 100, 112, 99, 111], ("d4", 86.0)), "HEAD_SHOULDERS": ([110, 100, 130, 102, 112], ("d4", 72.0)),
        "BOX_FROM_TOP": ([110, 100, 110.5, 100.2], ("d3", None)), "TRIANGLE_FROM_TOP": ([120, 90, 110, 95], ("d3", None)), "ASCENDING_TRIANGLE": ([110, 95, 110.5, 103], ("d3", 126.0)),
        "RISING_WEDGE": ([110, 95, 112, 102], ("d3", 95.0)), "FIVE_WAVES_DOWN": ([130, 120, 126, 100, 108, 90], ("d5", None)),
        # B takes back 0.618 of XA, C 0.5 of AB, D 0.786 of XA.
        "GARTLEY_FROM_TOP": ([150, 50, 111.8, 80.9, 128.6], ("d4", None)), "CRAB_FROM_TOP": ([150, 50, 100, 75, 211.8], ("d4", None)),
    }
    mirror = {s.name: s.mirrored for s in SHAPES}
    for name, (points, told) in drawn.items():
        up, down = found(spark, points, 1), found(spark, flipped(points), -1)
        assert up[name][0] == down[mirror[name]][0] == told[0], name
        if told[1] is not None and not any(x in name for x in ("DOUBLE", "TRIPLE")):
            assert abs(up[name][1] - told[1]) < 1e-9 and abs(down[mirror[name]][1] - (200 - told[1])) < 1e-9
        assert name not in down and mirror[name] not in up
    assert found(spark, [110, 100, 120], 1) == {} and found(spark, [110, 100], 1) == {}


def test_matches_against_a_plain_matcher(spark):
    rng = np.random.default_rng(12)
    near = lambda a, b, share: abs(a - b) < share * abs(a)
    rows, want = [], set()
    for s in range(60):
        way = 1 if s % 2 else -1
        prices = [float(x) for x in 100 + np.array([way * (-1) ** k for k in range(12)]) * rng.integers(1, 12, 12)]
        for k, p in enumerate(prices):
            w = way * (-1) ** k
            rows.append((s, k, k, p, w))
            q = [x * w for x in prices[k:]]
            tell = lambda n, name, mirrored: want.add((s, name if w > 0 else mirrored, k, k + n - 1))  # noqa: B023, E731
            if len(q) >= 3 and near(q[0], q[2], 0.045):
                tell(3, "DOUBLE_TOP", "DOUBLE_BOTTOM")
            if len(q) >= 5 and near(q[0], q[2], 0.045) and near(q[0], q[4], 0.045):
                tell(5, "TRIPLE_TOP", "TRIPLE_BOTTOM")
            if len(q) >= 5 and q[2] > q[0] and q[2] > q[4]:
                tell(5, "HEAD_SHOULDERS", "INVERSE_HEAD_SHOULDERS")
            if len(q) >= 4 and q[2] < q[0] and q[3] > q[1]:
                tell(4, "TRIANGLE_FROM_TOP", "TRIANGLE_FROM_BOTTOM")
    frame = spark.createDataFrame(rows, "symbol long, point long, date long, price double, way long")
    names = {n for _, n, *_ in want}
    got = {(r["symbol"], r["shape"], r["first"], r["last"]) for r in matched(frame, "symbol", "point", SHAPES).collect() if r["shape"] in names}
    assert got == want and len(names) == 8

"""Known results, and operators without SQL against plain loops."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.normal import normal_cdf
from marketloom.functions.ranks import benjamini_hochberg
from marketloom.functions.text import fold_letters, parse_number, unit_scale
from marketloom.operators import recursive
from marketloom.operators.ledger import call_auction, moving_average_cost, walk_depth
from marketloom.plans import catalog, risk
from marketloom.plans.documents import split_lines
from marketloom.sources.tables import bars

LEDGER = "symbol string, seq int, side string, shares double, gross double, fee double, tax double"


def ledger(spark, *rows):
    frame = spark.createDataFrame([("A", k, *map(lambda x: float(x) if not isinstance(x, str) else x, r)) for k, r in enumerate(rows)], LEDGER)
    return sorted(moving_average_cost(frame, "symbol", "seq").collect(), key=lambda r: r["seq"])


def test_ledger_of_purchases_and_a_partial_sale(spark):
    got = ledger(spark, ("BUY", 100, 1_000_000, 10_000, 0), ("BUY", 100, 2_000_000, 10_000, 0), ("SELL", 50, 1_000_000, 10_000, 1_000))
    assert got[-1]["pnl"] == pytest.approx(234_000) and got[-1]["cost"] == pytest.approx(2_265_000)


def test_ledger_that_sells_all_and_begins_anew(spark):
    got = ledger(spark, ("BUY", 100, 1_000_000, 10_000, 0), ("SELL", 100, 1_200_000, 10_000, 1_200), ("BUY", 10, 500, 5, 0), ("SELL", 20, 100, 0, 0), ("BUY", 30, 100, 0, 0))
    assert got[1]["pnl"] == pytest.approx(178_800) and got[1]["cost"] == 0 and got[2]["cost"] == pytest.approx(505)
    # From the first sale of what isn't held on, nothing is told.
    assert got[3]["cost"] is None and got[4]["cost"] is None and got[3]["pnl"] is None


def test_call_auction_and_depth(spark):
    orders = [("BUY", 21_600, 500), ("BUY", 21_500, 400), ("SELL", 21_450, 300), ("SELL", 21_500, 500)]
    frame = spark.createDataFrame([("A", s, float(p), float(v), 21_500.0) for s, p, v in orders], "symbol string, side string, price double, volume double, reference double")
    assert [tuple(r) for r in call_auction(frame, "symbol", "reference").collect()] == [("A", 21_500.0, 800.0)]
    levels = spark.createDataFrame([(1, 21_500.0, 200.0), (1, 21_500.0, 300.0), (1, 21.55, 400.0), (1, -1.0, 900.0), (2, 21_600.0, 50.0)], "book int, price double, volume double")
    got = {r["book"]: r for r in walk_depth(levels, "book", "price", "volume", 600, limit=21_550.0).collect()}
    assert got[1]["notional"] == 500 * 21_500 + 100 * 21_550 and 2 not in got
    assert [r["price"] for r in walk_depth(levels, "book", "price", "volume", 600).filter("book = 2").collect()] == [None]


def test_numbers_units_and_letters(spark):
    raw = {"1,5": 1.5, "1.000": 1000.0, "1.234,5": 1234.5, "(1.234)": -1234.0, "-7": -7.0, "12,345,678": 12345678.0, "1,23,4": None, "-": None, "": None, "x": None, "0.5": 0.5}
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", parse_number(F.col("raw")).alias("v")).collect()
    assert {r["raw"]: r["v"] for r in rows} == raw
    one = spark.createDataFrame([("Đơn vị tính: Triệu đồng",)], "t string").select(unit_scale(F.col("t")), fold_letters(F.col("t"))).first()
    assert tuple(one) == (1e6, "don vi tinh: trieu dong")


def test_tail_fallback_and_the_normal_distribution(spark):
    assert risk.DEFAULT_SIGMA * risk.T_MULTIPLE == pytest.approx(0.014 * 3.37)
    z = [-4.0, -1.0, 0.0, 0.3, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in z], abs=2e-7)


def test_false_discovery_adjustment(spark):
    rng = np.random.default_rng(2)
    p = np.r_[rng.random(300) ** 4, 0.0, 1.0, 0.5, 0.5]
    order = np.argsort(p, kind="stable")
    want = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(max=1)
    rows = benjamini_hochberg(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double"), "p", "i", "q").collect()
    got = np.empty(len(p))
    got[[r["i"] for r in rows]] = [r["q"] for r in rows]
    assert got[order] == pytest.approx(want)


def test_chunks_of_lines():
    assert split_lines([], 10, 3) == [] and split_lines([50], 10, 3) == [(1, 1)]
    assert split_lines([4, 4, 4, 4], 10, 3) == [(1, 2), (2, 3), (3, 4)]
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 30, 60).tolist()
        out = split_lines(sizes, 100, 20)
        assert out[0][0] == 1 and out[-1][1] == 60 and all(b[0] <= a[1] + 1 and b[1] > a[1] for a, b in zip(out, out[1:], strict=False))
        assert all(sum(sizes[b[0] - 1 : a[1]]) >= 20 or b[0] == a[0] for a, b in zip(out, out[1:], strict=False))


def by_symbol(spark, small):
    out = {}
    for r in sorted(bars(spark, small).collect(), key=lambda r: (r["symbol"], r["date"])):
        out.setdefault(r["symbol"], []).append(r)
    return out


def test_renko_by_counting_boxes(spark, small):
    want = {}
    for symbol, rows in by_symbol(spark, small).items():
        first, box, hi, lo, k = rows[0]["close"], rows[0]["close"] * 0.25, 0, 0, 0
        for r in rows:
            while r["close"] >= first + (hi + 1) * box - 1e-7:
                want[symbol, k] = (first + hi * box, 1)
                lo, hi, k = hi, hi + 1, k + 1
            while r["close"] <= first + (lo - 1) * box + 1e-7:
                want[symbol, k] = (first + lo * box, -1)
                lo, hi, k = lo - 1, lo, k + 1
    got = {(r["symbol"], r["brick"]): (r["brick_open"], r["direction"]) for r in catalog.QUERIES["renko_bricks"](spark, small).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(x, rel=1e-6, abs=1e-3), way) for k, (x, way) in want.items())


def test_volatility_is_at_a_likely_place(spark, small):
    def loss(r, alpha, beta, gamma):
        target = float(np.var(r, ddof=1))
        base, s, out = target * (1 - alpha - beta - gamma / 2), target, 0.0
        if base <= 0 or alpha + beta + gamma / 2 >= 0.999 or min(alpha, beta, gamma) < 0:
            return math.inf
        for x in r:
            out += (math.log(s) + x * x / s) / 2
            s = base + (alpha + gamma * (x < 0)) * x * x + beta * s
        return out

    got = {r["symbol"]: r for r in catalog.QUERIES["garch_volatility"](spark, small).collect()}
    for symbol, rows in by_symbol(spark, small).items():
        c = np.array([r["close"] for r in rows])
        r = np.log(c[1:] / c[:-1])
        r = r - r.mean()
        at = np.array([got[symbol][k] for k in ("alpha", "beta", "gamma")])
        best = loss(r, *at)
        assert math.isfinite(best)
        for step in np.vstack([np.eye(3), -np.eye(3)]) * 0.05:
            assert best <= loss(r, *(at + step)) + 1e-3
        batch, _ = recursive.garch_loss(r[:, None], *at[:, None, None])
        assert batch[0, 0] == pytest.approx(best)

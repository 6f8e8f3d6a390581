"""Components, unit-root statistics and the split as-of join against numpy and plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import components
from marketloom.operators.relational import asof_backward
from marketloom.plans import catalog, spaces
from marketloom.plans.regimes import weights
from marketloom.sources.tables import bars


def test_components_and_their_shares_equal_numpys(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5)) * [1, 10, 0.1, 3, 2] + 7
    rows = [(k, *map(float, r)) for k, r in enumerate(x)] + [(999, None, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e double")
    model = components.fit(frame, {"all": list("abcde"), "two": ["a", "b"]}, number=5)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    told = {}
    for r in model.filter("name = 'all'").collect():
        told.setdefault(r["component"], {})[r["factor"]] = r
    for k in range(5):
        want = vectors[:, 4 - k] * (1 if vectors[:, 4 - k].sum() >= 0 else -1)
        assert [told[k][f]["share"] for f in "abcde"] == pytest.approx([values[4 - k] / 5] * 5, rel=1e-6)
        assert [told[k][f]["loading"] for f in "abcde"] == pytest.approx(want.tolist(), abs=1e-5)
    z = (x - x.mean(0)) / x.std(0)
    got = {r["k"]: r for r in components.transform(frame, model, ["k"]).collect()}
    assert got[999]["all"] is None and got[3]["all_1"] == pytest.approx(float(z[3] @ [told[1][f]["loading"] for f in "abcde"]))


def test_clusters_follow_chains_of_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 3))
    x = np.c_[base[:, 0], base[:, 0] + 0.6 * base[:, 1], base[:, 1] + 0.6 * base[:, 0], base[:, 2], np.zeros(300)]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "d double, b double, c double, a double, flat double")
    got = {r["factor"]: (r["cluster"], r["with"]) for r in components.clusters(frame, ["d", "b", "c", "a", "flat"], 0.7).collect()}
    c = np.corrcoef(x[:, :4].T)
    assert abs(c[0, 1]) > 0.7 and abs(c[1, 2]) > 0.7 > abs(c[0, 2])
    assert got == {"d": ("b", ["b"]), "b": ("b", ["c", "d"]), "c": ("b", ["b"])}


def test_chosen_order_equals_a_plain_search(spark, medium):
    got = {r["symbol"]: r for r in catalog.QUERIES["stationary_order"](spark, medium).collect()}
    series = {}
    for r in sorted(bars(spark, medium).collect(), key=lambda r: (r["symbol"], r["date"])):
        series.setdefault(r["symbol"], []).append(np.log(r["close"]))
    chosen = set()
    for symbol, x in list(series.items())[:30]:
        x, want = np.array(x), (1.0, None)
        for order in spaces.ORDERS:
            w = weights(order, spaces.SMALLEST) if 0 < order < 1 else [1.0] if order == 0 else [1.0, -1.0]
            y = np.convolve(x, w, "valid")
            step = np.diff(y)
            if len(step) - 1 < spaces.FEWEST:
                continue
            design = np.c_[np.ones(len(step) - 1), y[1:-1], step[:-1]]
            beta, *_ = np.linalg.lstsq(design, step[1:], rcond=None)
            rest = step[1:] - design @ beta
            error = np.sqrt(rest @ rest / (len(rest) - 3) * np.linalg.inv(design.T @ design)[1, 1])
            if beta[1] / error < spaces.CRITICAL:
                want = (order, beta[1] / error)
                break
        assert got[symbol]["order_"] == want[0]
        assert got[symbol]["statistic"] == (None if want[1] is None else pytest.approx(want[1], abs=1e-4))
        chosen.add(want[0])


def test_asof_join_split_by_period_equals_the_whole(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab") if k % 5 else "hot", rng.randint(0, 500), k) for k in range(600)]
    right = list({(key, t): (key, t, rng.choice([None, k])) for k, (key, t) in enumerate((rng.choice(["a", "hot", "hot", "c"]), rng.randint(0, 500)) for _ in range(300))}.values())
    l, r = spark.createDataFrame(left, "key string, t long, k long"), spark.createDataFrame(right, "key string, t long, v long")
    take = {"v": "v", "t": "seen"}
    whole = asof_backward(l, r, ["key"], "t", take)
    for width in (1, 40, 1000):
        split = asof_backward(l, r, ["key"], "t", take, period=lambda t, width=width: F.floor(t / width))
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    want = {}
    for key, t, k in left:
        seen = [x for x in right if x[0] == key and x[1] <= t]
        want[k] = max(seen, key=lambda x: x[1])[1:] if seen else (None, None)
    assert {x["k"]: (x["seen"], x["v"]) for x in whole.collect()} == want

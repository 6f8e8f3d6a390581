"""The ranker: pulls and splits by plain loops, and what it gains on dates it hasn't seen."""

from __future__ import annotations

import os

import numpy as np
import pytest

from marketloom.functions import ranks
from marketloom.operators import ranking
from marketloom.operators.steps import written
from marketloom.plans import catalog, ranker
from marketloom.sources import tables


def plain_pulls(score, grade, top):
    n, order = len(score), np.argsort(-score, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    gain = [2.0 ** int(y) - 1 for y in grade]
    best = sum(g / np.log2(k + 2) for k, g in enumerate(sorted(gain, reverse=True)[:top]))
    up, bend = np.zeros(n), np.zeros(n)
    for i in range(n):
        for j in range(n):
            if grade[i] > grade[j] and min(rank[i], rank[j]) < top:
                moved = (gain[i] - gain[j]) * abs(1 / np.log2(rank[i] + 2) - 1 / np.log2(rank[j] + 2)) / best
                wrong = 1 / (1 + np.exp(score[i] - score[j]))
                for k, sign in ((i, 1), (j, -1)):
                    up[k] += sign * wrong * moved
                    bend[k] += wrong * (1 - wrong) * moved
    return up, bend


@pytest.mark.parametrize("chunk", [3, 1000])
def test_pulls_equal_all_pairs(monkeypatch, chunk):
    monkeypatch.setattr(ranking, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    for n in (2, 5, 23):
        score, grade = rng.standard_normal(n).round(1), rng.integers(0, 5, n).astype(np.uint8)
        if grade.any():
            assert np.allclose(ranking.pulls(score, grade, 4), plain_pulls(score, grade, 4))
    grade = np.array([4, ranking.NONE, 0, 2], np.uint8)
    up, _ = ranking.pulls(np.zeros(4), grade)
    assert up[1] == 0 and up[0] > 0 > up[2]
    assert not ranking.pulls(np.zeros(3), np.zeros(3, np.uint8))[0].any()


def test_first_split_is_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, *map(float, rng.standard_normal(3)), None) for g in range(30) for i in range(40)]
    rows = [(g, i, a, b if i % 7 else None, c, int(np.clip(2 + 1.5 * (a > 0.3) + 0.4 * b, 0, 4))) for g, i, a, b, c, _ in rows]
    frame = spark.createDataFrame(rows, "g long, i long, a double, b double, c double, y int")
    cuts = ranking.cuts_of(frame, ["a", "b", "c"], 16)
    groups = ranking.grouped(frame, "g", "i", ["a", "b", "c"], "y", cuts)
    assert groups.count() == 30
    (tree,) = ranking.fit(groups, 3, trees=1, depth=1, rate=1.0, bins=16)
    pull, curve, x = [], [], []
    for g in range(30):
        own = [r for r in rows if r[0] == g]
        up, bend = ranking.pulls(np.zeros(40), np.array([r[5] for r in own], np.uint8))
        pull, curve = np.r_[pull, up], np.r_[curve, bend]
        x += [[0 if r[2 + k] is None else 1 + np.searchsorted(cuts[k], r[2 + k]) for k in range(3)] for r in own]
    x, best = np.array(x), (-1, None)
    for f in range(3):
        for c in range(16):
            low = x[:, f] <= c
            if min(curve[low].sum(), curve[~low].sum()) >= 1e-3:
                won = sum(pull[s].sum() ** 2 / (curve[s].sum() + 1e-2) for s in (low, ~low)) - pull.sum() ** 2 / (curve.sum() + 1e-2)
                best = max(best, (won, (f, c)))
    f, c = best[1]
    assert (tree.feature[0], tree.cut[0]) == (f, c) == (0, c)
    low = x[:, f] <= c
    assert tree.value == pytest.approx([pull[s].sum() / (curve[s].sum() + 1e-2) for s in (low, ~low)])


def test_a_tree_pulls_once_and_leaves_no_step(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(rng.standard_normal()), float(rng.standard_normal()), int(rng.integers(0, 5))) for g in range(12) for i in range(45)]
    frame = spark.createDataFrame(rows, "g long, i long, a double, b double, y int")
    groups = ranking.grouped(frame, "g", "i", ["a", "b"], "y", ranking.cuts_of(frame, ["a", "b"]))
    steps = []

    def noted(df):
        steps.append(written(df))
        return steps[-1]

    monkeypatch.setattr(ranking, "written", noted)
    trees = ranking.fit(groups, 2, trees=3, depth=2)
    assert len(trees) == len(steps) == 3
    assert not any(os.path.exists(s._written_at.removeprefix("file:")) for s in steps)
    # The pulls that a tree is grown from are those of all trees before it.
    held = ranking._pulled(groups.select("x", "y"), None, 2, ranking.TOP)
    for k in range(2):
        held = ranking._pulled(held.select("x", "y", "s"), trees[k], 2, ranking.TOP)
    for r in held.collect():
        x, y = np.frombuffer(r["x"], np.uint8).reshape(-1, 2), np.frombuffer(r["y"], np.uint8)
        score = ranking.scored(trees[:2], x)
        assert (np.frombuffer(r["s"]) == score).all()
        assert all((np.frombuffer(r[c]) == v).all() for c, v in zip("ab", ranking.pulls(score, y), strict=True))


@pytest.mark.parametrize("frame", [ranker.graded, catalog.QUERIES["feature_forge"]])
def test_bars_are_made_once(spark, small, monkeypatch, frame):
    read, load = [], tables.load
    monkeypatch.setattr(tables, "load", lambda s, d, name: read.append(name) or load(s, d, name))
    rows = frame(spark, small)
    assert read == ["lineitem"]
    assert rows.count() and not any("lineitem" in f for f in rows.inputFiles())


def test_told_borders_give_the_same_buckets(spark):
    rows = [(g, k, None if k % 5 == 0 else float(k * 7 % 11)) for g in range(3) for k in range(23 * g + 1)]
    frame = spark.createDataFrame(rows, "g long, k long, x double")
    told = ranks.above(frame.join(ranks.quantiles(frame, "x", "g", 5), "g"), "x", "q")
    assert sorted(told.select("g", "k", "q").collect()) == sorted(ranks.quantile_bucket(frame, "x", "g", 5, "q").select("g", "k", "q").collect())


def test_held_out_dates_are_ordered_better_than_by_momentum(spark, medium):
    rows = ranker.graded(spark, medium).collect()
    told = {(str(r["date"]), r["symbol"]): r for r in rows}
    got = catalog.QUERIES["learned_ranks"](spark, medium).collect()
    dates = sorted({str(r["date"]) for r in rows})
    later = sorted({r["date"] for r in got})
    assert set(later) == set(dates[int(len(dates) * ranker.TRAIN) + 1 :])
    mine, theirs = [], []
    for date in later:
        own = [r for r in got if r["date"] == date and told[date, r["symbol"]]["grade"] is not None]
        if not own:
            continue
        grade = np.array([told[date, r["symbol"]]["grade"] for r in own])
        momentum = np.array([told[date, r["symbol"]]["momentum"] or 0.0 for r in own])
        assert sorted(r["rank"] for r in got if r["date"] == date) == list(range(1, sum(r["date"] == date for r in got) + 1))
        mine.append(ranking.ndcg(np.array([r["score"] for r in own]), grade, 10))
        theirs.append(ranking.ndcg(momentum, grade, 10))
    assert np.mean(mine) > np.mean(theirs) + 0.1
    assert np.mean(mine) > 0.6

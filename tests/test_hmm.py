"""Regimes by scans over blocks against plain loops over the steps."""

from __future__ import annotations

import numpy as np
import pytest

from marketloom.operators import hmm
from marketloom.plans import catalog, regimes


def simulated(n, seed):
    rng = np.random.default_rng(seed)
    moves = np.array([[0.95, 0.04, 0.01], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]])
    means = np.array([[1.0, -0.5], [0.0, 0.3], [-1.2, 0.8]])
    state, x = 0, []
    for _ in range(n):
        state = rng.choice(3, p=moves[state])
        x.append(means[state] + rng.standard_normal(2) * [0.7, 0.5])
    return np.array(x)


def guess():
    return hmm.Model(np.full(3, 1 / 3), np.full((3, 3), 0.05) + 0.85 * np.eye(3), np.array([[0.5, 0.0], [0.0, 0.0], [-0.5, 0.0]]), np.eye(2))


def blocks(spark, x, rows):
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "t long, x array<double>")
    return hmm.blocks_of(frame.orderBy("t", ascending=False), "t", "x", rows)


def density(model, x):
    inverse, det = np.linalg.inv(model.covariance), np.linalg.det(2 * np.pi * model.covariance)
    return np.array([[np.exp(-0.5 * (r - m) @ inverse @ (r - m)) / np.sqrt(det) for m in model.means] for r in x])


def plain(model, x):
    """Filtered and smoothed probabilities, expected moves and the log-likelihood, step by step."""
    b, n = density(model, x), len(x)
    forward, scale = np.zeros((n, 3)), np.zeros(n)
    for t in range(n):
        a = (model.start if t == 0 else forward[t - 1] @ model.moves) * b[t]
        scale[t] = a.sum()
        forward[t] = a / scale[t]
    backward = np.ones((n, 3))
    for t in range(n - 2, -1, -1):
        backward[t] = model.moves @ (b[t + 1] * backward[t + 1]) / scale[t + 1]
    state = forward * backward
    moves = sum(forward[t - 1][:, None] * model.moves * (b[t] * backward[t])[None, :] / scale[t] for t in range(1, n))
    return forward, state / state.sum(1)[:, None], moves, np.log(scale).sum()


def viterbi(model, x):
    b, n = np.log(density(model, x)), len(x)
    best, back = np.log(model.start) + b[0], np.zeros((n, 3), int)
    for t in range(1, n):
        ways = best[:, None] + np.log(model.moves)
        back[t], best = ways.argmax(0), ways.max(0) + b[t]
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_passes_over_blocks_equal_passes_over_steps(spark, rows):
    x = simulated(150, rows)
    held, model = blocks(spark, x, rows), guess()
    forward, state, _, _ = plain(model, x)
    for smoothed, want in ((False, forward), (True, state)):
        got = sorted(tuple(r) for r in hmm.probabilities(held, model, smoothed).collect())
        assert [r[0] for r in got] == list(range(150))
        assert np.allclose([r[1:] for r in got], want, atol=1e-10)
    assert [r["state"] for r in sorted(hmm.likely_path(held, model).collect())] == viterbi(model, x)


def test_training_follows_plain_expectation_maximisation(spark):
    x = simulated(400, 3)
    got, course = hmm.fit(blocks(spark, x, 30), guess(), rounds=12, least=0)
    model, logs = guess(), []
    for _ in range(12):
        _, state, moves, log = plain(model, x)
        logs.append(log)
        weight = state.sum(0)
        means = state.T @ x / weight[:, None]
        spread = sum(state[t, s] * np.outer(x[t] - means[s], x[t] - means[s]) for t in range(len(x)) for s in range(3)) / len(x)
        model = hmm.Model(state[0], moves / moves.sum(1)[:, None], means, spread + hmm.RIDGE * np.eye(2))
    assert np.allclose(course, logs, rtol=1e-9) and course[-1] > course[0] + 50
    for a, b in ((got.start, model.start), (got.moves, model.moves), (got.means, model.means), (got.covariance, model.covariance)):
        assert np.allclose(a, b, atol=1e-8)


def test_recurrences_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.random(200), rng.random(200) * 0.99], 1)
    got = [r[1] for r in sorted(hmm.recurrence(blocks(spark, x, 9), lambda x: (x[:, 0], x[:, 1]), 2.5, 2, "y").collect())]
    y, want = 2.5, []
    for a, b in x:
        y = a + b * y
        want.append(y)
    assert np.allclose(got, want, rtol=1e-12)


def test_regimes_are_named_by_return_and_volatility_switches(spark, small):
    rows = sorted(catalog.QUERIES["regime_hmm"](spark, small).collect())
    returns = {str(r["day"]): r["r"] for r in regimes.features(spark, small).collect()}
    assert len(rows) == len(returns) > 1000
    late = rows[regimes.WARM :]
    by = {n: np.mean([returns[r["day"]] for r in late if r["regime"] == n]) for n in {r["regime"] for r in late}}
    assert list(by) and sorted(by, key=by.get) == [n for n in ("BEAR_MARKET", "RANGE_BOUND", "BULL_MARKET") if n in by]
    assert all(abs(r["p_bull"] + r["p_range"] + r["p_bear"] - 1) < 3e-6 for r in rows)
    # Volatility by the plain recursion.
    r = np.array([returns[x["day"]] for x in rows])
    p = np.array([[x["p_bull"], x["p_range"], x["p_bear"]] for x in rows])
    names = ["BULL_MARKET", "RANGE_BOUND", "BEAR_MARKET"]
    shares = {n: regimes.regime_shares(float((p[:, k] * r * r).sum() / p[:, k].sum())) for k, n in enumerate(names)}
    variance = float(np.var(r))
    for t, x in enumerate(rows):
        if t:
            omega, alpha, beta, gamma = shares[x["regime"]]
            variance = omega + (alpha + gamma * (r[t - 1] < 0)) * r[t - 1] ** 2 + beta * variance
        assert x["volatility"] == pytest.approx(np.sqrt(variance), rel=1e-4, abs=2e-6)

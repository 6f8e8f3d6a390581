"""Components of groups of factors: fitted on some rows, stored as a table, applied to others.

Means, deviations and correlations of any number of factors are one aggregate over the
rows; what goes to the driver has the size of the factors squared. Components are found
there by power iteration with deflation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.steps import written

MODEL = "name string, component int, factor string, mean double, sd double, loading double, share double"
ROUNDS = 1000


def moments(rows: DataFrame, factors: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and correlations of the rows in which all factors have values."""
    whole = rows.dropna(subset=factors)
    pairs = [(i, j) for i in range(len(factors)) for j in range(i, len(factors))]
    told = whole.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(factors)], *[F.covar_pop(factors[i], factors[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    mean = np.array([told[f"m{i}"] or 0.0 for i in range(len(factors))])
    cov = np.zeros((len(factors),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = told[f"c{i}_{j}"] or 0.0
    sd = np.sqrt(np.diag(cov))
    safe = np.where(sd > 0, sd, 1.0)
    return mean, sd, cov / np.outer(safe, safe)


def leading(matrix: np.ndarray, number: int = 1, rounds: int = ROUNDS) -> list[tuple[float, np.ndarray]]:
    """The largest characteristic values of a correlation matrix and their vectors, whose sum isn't negative."""
    out, rest = [], matrix.copy()
    for _ in range(number):
        # A start that no symmetry makes orthogonal to what is sought.
        v = 1 + np.arange(len(rest)) / (10.0 * len(rest))
        v /= np.sqrt(v @ v)
        for _ in range(rounds):
            new = rest @ v
            size = np.sqrt(new @ new)
            if size < 1e-300:
                break
            new /= size
            done = np.abs(new - v).max() < 1e-15
            v = new
            if done:
                break
        v = v if v.sum() >= 0 else -v
        value = float(v @ rest @ v)
        out.append((value, v))
        rest = rest - value * np.outer(v, v)
    return out


def fit(rows: DataFrame, groups: dict[str, list[str]], number: int = 1) -> DataFrame:
    """A written row per group, component and factor: how the component is made of it, and the share of variance explained."""
    told = []
    for name, factors in groups.items():
        mean, sd, correlation = moments(rows, factors)
        for k, (value, vector) in enumerate(leading(correlation, min(number, len(factors)))):
            told += [(name, k, f, float(m), float(s), float(x), value / len(factors)) for f, m, s, x in zip(factors, mean, sd, vector, strict=True)]
    return written(rows.sparkSession.createDataFrame(told, MODEL))


def transform(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a column per group and component, by the stored model; null where a factor of the group is."""
    made: dict[str, list] = {}
    for r in sorted(model.collect(), key=lambda r: (r["name"], r["component"], r["factor"])):
        made.setdefault(f"{r['name']}_{r['component']}" if r["component"] else r["name"], []).append(r)
    columns = [sum((F.col(r["factor"]) - r["mean"]) / (r["sd"] or 1.0) * r["loading"] for r in parts).alias(n) for n, parts in made.items()]
    return rows.select(*keys, *columns)


def clusters(rows: DataFrame, factors: list[str], least: float) -> DataFrame:
    """factor, cluster (its first factor by name) and with: the other factors whose correlation with it is beyond ``least``.

    Clusters join what a chain of such pairs joins; factors without a pair are left out.
    """
    _, _, c = moments(rows, factors)
    near = [[j for j in range(len(factors)) if j != i and abs(c[i, j]) > least] for i in range(len(factors))]
    first = {i: factors[i] for i in range(len(factors))}
    for _ in factors:
        first = {i: min([first[i], *(first[j] for j in near[i])]) for i in first}
    told = [(factors[i], first[i], sorted(factors[j] for j in near[i])) for i in first if near[i]]
    return rows.sparkSession.createDataFrame(told, "factor string, cluster string, with array<string>")

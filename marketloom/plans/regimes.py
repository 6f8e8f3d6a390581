"""Market regimes: six features of the market's days, hidden states, and volatility by regime.

The market's day has the mean price of its trades, their volume, a signed flow (returned
goods out, accepted ones in, which stands for foreign investors) and the mean tax rate
(for the interbank rate). There is one row a day, so these windows are over the calendar.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import hmm
from marketloom.operators.steps import written
from marketloom.plans.catalog import query
from marketloom.plans.risk import r6
from marketloom.sources.tables import load

FEATURES = ("trend", "momentum", "activity", "turbulence", "inflow", "rate")
#: Days before which a window of a year isn't full.
WARM = 252
#: The means that training starts from (bull, range, bear), and how strongly states persist.
MEANS = [[0.5, 0.5, 0.0, -0.5, 0.0, -0.2], [0.0, 0.0, -0.5, -0.5, 0.0, 0.0], [-0.5, -0.5, 0.5, 1.0, -0.5, 0.5]]
STAY, LEAVE = 0.95, 0.01
ORDER, SMALLEST = 0.4, 1e-3


def weights(order: float = ORDER, smallest: float = SMALLEST) -> list[float]:
    """Weights of a fractional difference, down to the smallest."""
    out = [1.0]
    while True:
        k = len(out)
        w = -out[-1] * (order - k + 1) / k
        if abs(w) < smallest:
            return out
        out.append(w)


def _difference(column: str) -> str:
    return f"coalesce({' + '.join(f'{w!r}D * lag({column}, {k}) OVER o' if k else column for k, w in enumerate(weights()))}, 0D)"


def _score(column: str, least: str) -> str:
    return f"({column} - avg({column}) OVER y) / coalesce(nullif(stddev_samp({column}) OVER y, 0), {least})"


#: Steps of columns in SQL that both engines read; o, m and y are all days so far, 20 of them, and 252.
_STEPS = [
    {"x": "ln(close)", "r": "coalesce(close / lag(close) OVER o - 1, 0)"},
    {"v": "coalesce(stddev_samp(r) OVER m, 0.015)"},
    {
        "trend": _difference("x"), "momentum": "close / avg(close) OVER m - 1", "activity": "volume / (avg(volume) OVER m + 0.00000001) - 1",
        "turbulence": _score("v", "0.001"), "inflow": _score("flow", "1000000.0"), "rate": _difference("tax"),
    },
]
_SPANS = {"o": "(ORDER BY day)", "m": "(ORDER BY day ROWS 19 PRECEDING)", "y": f"(ORDER BY day ROWS {WARM - 1} PRECEDING)"}


def _sql(expression: str, engine: str) -> str:
    for name, span in _SPANS.items():
        expression = expression.replace(f"OVER {name}", f"OVER {span}")
    return expression if engine == "spark" else expression.replace("D * lag", " * lag").replace(", 0D)", ", 0)").replace("1.0D", "1.0")


SQL_DAYS = """days AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, avg(l_tax) AS tax,
  sum(CASE l_returnflag WHEN 'R' THEN -l_quantity WHEN 'A' THEN l_quantity ELSE 0 END) AS flow FROM lineitem GROUP BY ALL)"""
_steps_sql, _from = [], "days"
for _k, _step in enumerate(_STEPS):
    _steps_sql.append(f"f{_k} AS (SELECT *, {', '.join(f'{_sql(e, 'duck')} AS {n}' for n, e in _step.items())} FROM {_from})")
    _from = f"f{_k}"
_scaled = ", ".join(f"least(greatest(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 0.00000001), -3), 3) AS {c}" for c in FEATURES)
SQL_FEATURES = f"{SQL_DAYS}, {', '.join(_steps_sql)}, features AS (SELECT day, r, row_number() OVER (ORDER BY day) AS i, {_scaled} FROM {_from})"


def features(spark: SparkSession, d: str) -> DataFrame:
    """day, r and the six features, scaled over all days and cut at three deviations."""
    flow = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)
    days = load(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.avg("l_tax").alias("tax"), F.sum(flow).alias("flow")
    )
    days = written(days).repartition(1)
    for step in _STEPS:
        days = days.selectExpr("*", *(f"{_sql(e, 'spark')} AS {n}" for n, e in step.items()))
    days = written(days.select("day", "r", *FEATURES))
    about = days.agg(*(F.avg(c).alias(f"{c}_mean") for c in FEATURES), *((F.stddev_pop(c) + 1e-8).alias(f"{c}_sd") for c in FEATURES))
    scaled = days.crossJoin(F.broadcast(about))
    cut = lambda c: F.least(F.greatest((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd"), F.lit(-3.0)), F.lit(3.0))
    return scaled.select("day", "r", *(cut(c).alias(c) for c in FEATURES))


def first_guess() -> hmm.Model:
    k = len(MEANS)
    moves = np.full((k, k), LEAVE) + (STAY - LEAVE) * np.eye(k)
    return hmm.Model(np.full(k, 1 / k), moves / moves.sum(1)[:, None], np.array(MEANS), np.eye(len(FEATURES)))


_MOVE = [[float(x) for x in row] for row in first_guess().moves]
_DENSE = [f"exp(-0.5 * ({' + '.join(f'({c} - {m!r}) ** 2' for c, m in zip(FEATURES, means, strict=True))}))" for means in MEANS]
_NEXT = [f"({' + '.join(f'p{s} * {_MOVE[s][t]!r}' for s in range(3))})" for t in range(3)]


@query(
    "regime_filtered",
    f"""WITH RECURSIVE {SQL_FEATURES}, dense AS (SELECT day, i, {", ".join(f"{e} AS b{s}" for s, e in enumerate(_DENSE))} FROM features),
walk AS (SELECT day, i, b0 / (b0 + b1 + b2) AS p0, b1 / (b0 + b1 + b2) AS p1, b2 / (b0 + b1 + b2) AS p2 FROM dense WHERE i = 1
UNION ALL SELECT day, i, a0 / (a0 + a1 + a2), a1 / (a0 + a1 + a2), a2 / (a0 + a1 + a2) FROM (SELECT d.day, d.i, {", ".join(f"{e} * b{t} AS a{t}" for t, e in enumerate(_NEXT))} FROM walk w JOIN dense d ON d.i = w.i + 1))
SELECT day, round(p0, 6) AS p_bull, round(p1, 6) AS p_range, round(p2, 6) AS p_bear FROM walk""",
    dates=("day",),
)
def regime_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The regimes' probabilities from the days so far, by the model that training starts from."""
    blocks = hmm.blocks_of(features(spark, d).select("day", F.array(*FEATURES).alias("x")), "day", "x")
    p = hmm.probabilities(blocks, first_guess(), smoothed=False)
    return p.select(F.col("at").alias("day"), r6("p0").alias("p_bull"), r6("p1").alias("p_range"), r6("p2").alias("p_bear"))


#: Variance of a regime's returns from which, and shares of it: omega, alpha, beta and gamma.
CALM, WILD = 0.0001, 0.0004
SHARES = {"wild": (0.05, 0.15, 0.75, 0.20), "calm": (0.02, 0.03, 0.92, 0.05), "usual": (0.03, 0.08, 0.85, 0.10)}


def regime_shares(variance: float) -> tuple[float, float, float, float]:
    omega, alpha, beta, gamma = SHARES["wild" if variance > WILD else "calm" if variance < CALM else "usual"]
    return omega * variance, alpha, beta, gamma


@query("regime_hmm", dates=("day",))
def regime_hmm(spark: SparkSession, d: str) -> DataFrame:
    """Regimes of a model trained on all days but the first year: the likely path by name, probabilities given all days, and volatility that switches with the path.

    States are named by their days' mean return, the highest bull, the lowest bear.
    """
    f = written(features(spark, d))
    x = f.select("day", F.array(*FEATURES).alias("x"))
    blocks = hmm.blocks_of(x, "day", "x")
    warm = f.orderBy("day").limit(WARM).agg(F.max("day")).first()[0]
    later = x.filter(F.col("day") > F.lit(warm))
    later = later if not later.isEmpty() else x
    guess = first_guess()
    cov = later.select(*(F.col("x")[k].alias(c) for k, c in enumerate(FEATURES)))
    pairs = [(a, b) for a in FEATURES for b in FEATURES]
    told = cov.agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    guess.covariance = np.array([told[f"{a}_{b}"] or 0.0 for a, b in pairs]).reshape(len(FEATURES), -1) + hmm.RIDGE * np.eye(len(FEATURES))
    model, _ = hmm.fit(hmm.blocks_of(later, "day", "x"), guess)
    p = hmm.probabilities(blocks, model).withColumnRenamed("at", "day")
    path = hmm.likely_path(blocks, model).withColumnRenamed("at", "day")
    days = written(f.select("day", "r").join(path, "day").join(p, "day"))
    # Three rows: each state's mean return, and the variance of returns weighted by its probability.
    mean = {r["state"]: r["mean"] for r in days.filter((F.col("day") > F.lit(warm)) | F.lit(later is x)).groupBy("state").agg(F.avg("r").alias("mean")).collect()}
    ranked = sorted(range(3), key=lambda s: (-mean.get(s, -1e9), s))
    variances = days.agg(F.var_pop("r").alias("all"), *((F.sum(F.col(f"p{s}") * F.col("r") ** 2) / F.sum(f"p{s}")).alias(f"v{s}") for s in range(3))).first()
    shares = np.array([regime_shares(variances[f"v{s}"] or 0.0) for s in range(3)])

    def steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        omega, alpha, beta, gamma = shares[x[:, 1].astype(int)].T
        return omega + (alpha + gamma * (x[:, 0] < 0)) * x[:, 0] ** 2, beta

    # The first day has the overall variance.
    ordered = F.expr("lag(r) OVER (ORDER BY day)")
    later_days = days.repartition(1).select("day", F.array(ordered, F.col("state").cast("double")).alias("x")).filter("x[0] IS NOT NULL")
    variance = hmm.recurrence(hmm.blocks_of(later_days, "day", "x"), steps, variances["all"] or 0.0, 2, "variance").withColumnRenamed("at", "day")
    out = days.join(variance, "day", "left")
    name = F.element_at(F.create_map(*(F.lit(v) for s, n in zip(ranked, ("BULL_MARKET", "RANGE_BOUND", "BEAR_MARKET"), strict=True) for v in (s, n))), F.col("state"))
    volatility = F.sqrt(F.coalesce("variance", F.lit(variances["all"] or 0.0)))
    return out.select("day", name.alias("regime"), *(r6(f"p{s}").alias(c) for s, c in zip(ranked, ("p_bull", "p_range", "p_bear"), strict=True)), r6(volatility).alias("volatility"))

"""Factor spaces: components of groups of features, collinear clusters, and the order of differencing that makes a series stationary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import components
from marketloom.operators.steps import written
from marketloom.plans.catalog import SQL, query
from marketloom.plans.charts import lag, steps
from marketloom.plans.factors import feature_forge
from marketloom.plans.regimes import weights
from marketloom.sources.tables import SQL_BARS, bars

GROUPS = {"motion": ["ret1", "ret5", "relative"], "spread": ["vol20", "range20", "body"], "activity": ["volume_z", "gap", "upper"]}
#: Components are fitted up to this date, and applied after it.
UNTIL = "2000-01-01"
COLLINEAR = 0.6


def _component_sql(name: str, factors: list[str]) -> str:
    """The first component of three factors, by power iteration."""
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    c = {(i, j): f"c{min(i, j)}{max(i, j)}" if i != j else "1.0" for i in range(3) for j in range(3)}
    stats = ", ".join([f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(3)] + [f"covar_pop(x{i}, x{j}) / (stddev_pop(x{i}) * stddev_pop(x{j})) AS c{i}{j}" for i, j in pairs])
    step = [f"({' + '.join(f'{c[i, j]} * v{j}' for j in range(3))})" for i in range(3)]
    size = f"sqrt({' + '.join(f'{s} * {s}' for s in step)})"
    return f"""{name}_x AS (SELECT {", ".join(f"{f} AS x{i}" for i, f in enumerate(factors))} FROM forge WHERE date <= DATE '{UNTIL}' AND {" AND ".join(f"{f} IS NOT NULL" for f in factors)}),
{name}_s AS (SELECT {stats} FROM {name}_x),
{name}_i AS (SELECT 0 AS k, 1.0::DOUBLE AS v0, {1 + 1 / 30!r}::DOUBLE AS v1, {1 + 2 / 30!r}::DOUBLE AS v2 UNION ALL SELECT k + 1, {", ".join(f"{s} / {size}" for s in step)} FROM {name}_i, {name}_s WHERE k < 1000),
{name}_v AS (SELECT CASE WHEN v0 + v1 + v2 < 0 THEN -v0 ELSE v0 END AS v0, CASE WHEN v0 + v1 + v2 < 0 THEN -v1 ELSE v1 END AS v1, CASE WHEN v0 + v1 + v2 < 0 THEN -v2 ELSE v2 END AS v2 FROM {name}_i WHERE k = 1000)"""


_FORGE_SQL = SQL["feature_forge"].replace("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM (", "SELECT * REPLACE (CAST(date AS DATE) AS date) FROM (")
_VALUES = ", ".join("round(" + " + ".join(f"({f} - (SELECT m{i} FROM {n}_s)) / (SELECT s{i} FROM {n}_s) * (SELECT v{i} FROM {n}_v)" for i, f in enumerate(fs)) + f", 5) AS {n}" for n, fs in GROUPS.items())


@query("factor_components", f"WITH RECURSIVE forge AS ({_FORGE_SQL}), {', '.join(_component_sql(n, f) for n, f in GROUPS.items())} SELECT symbol, date, {_VALUES} FROM forge WHERE date > DATE '{UNTIL}'", dates=("date",))
def factor_components(spark: SparkSession, d: str) -> DataFrame:
    """The first component of each group of features, fitted on early dates, told of later ones by the stored transform."""
    forge = written(feature_forge(spark, d))
    model = components.fit(forge.filter(F.col("date") <= F.lit(UNTIL).cast("date")), GROUPS)
    later = components.transform(forge.filter(F.col("date") > F.lit(UNTIL).cast("date")), model, ["symbol", "date"])
    return later.withColumns({n: F.round(n, 5) for n in GROUPS})


_ALL = sorted({f for fs in GROUPS.values() for f in fs})
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS c FROM forge WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _ALL)}" for a in _ALL for b in _ALL if a != b)


@query(
    "factor_clusters",
    f"""WITH RECURSIVE forge AS ({_FORGE_SQL}), pairs AS (SELECT a, b FROM ({_PAIRS}) WHERE abs(c) > {COLLINEAR}), r AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON p.a = r.b)
SELECT a AS factor, least(a, min(b)) AS cluster, (SELECT string_agg(b, ',' ORDER BY b) FROM pairs p WHERE p.a = r.a) AS with_ FROM r GROUP BY a""",
)
def factor_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Features that are joined by strong correlations, directly or through others."""
    c = components.clusters(feature_forge(spark, d), _ALL, COLLINEAR)
    return c.select("factor", "cluster", F.array_join("with", ",").alias("with_"))


#: Orders that are tried, weights that count, values a regression needs, and the bound of its statistic at five percent (constant, no trend).
ORDERS, SMALLEST, FEWEST, CRITICAL = [k / 20 for k in range(21)], 0.01, 20, -2.8615


def _difference(order: float) -> str:
    told = weights(order, SMALLEST) if 0 < order < 1 else [1.0] if order == 0 else [1.0, -1.0]
    return " + ".join(f"{w!r} * {lag('x', k)}" if k else f"{w!r} * x" for k, w in enumerate(told))


def _statistic(k: int) -> str:
    """The statistic of the last value in a regression of the change on it and on the last change, by sums."""
    y, a, b = f"q{k}", f"l{k}", f"m{k}"
    s11, s22, s12, s1y, s2y, syy = (f"covar_pop({p}, {q})" for p, q in ((a, a), (b, b), (a, b), (a, y), (b, y), (y, y)))
    n, det = f"count({b})", f"({s11} * {s22} - {s12} * {s12})"
    first, second = f"(({s1y} * {s22} - {s2y} * {s12}) / nullif({det}, 0))", f"(({s2y} * {s11} - {s1y} * {s12}) / nullif({det}, 0))"
    rest = f"({syy} - {first} * {s1y} - {second} * {s2y})"
    return f"CASE WHEN {n} >= {FEWEST} AND {det} > 1e-24 AND {rest} > 1e-18 THEN {first} / sqrt({rest} / ({n} - 3) * {s22} / {det}) END"


_K = range(len(ORDERS))
_LAYERS = (
    {"x": "ln(close)"}, {f"y{k}": _difference(o) for k, o in enumerate(ORDERS)}, {f"p{k}": f"y{k} - {lag(f'y{k}')}" for k in _K},
    # Rows count only where the last change is known as well.
    {f"z{k}": lag(f"p{k}") for k in _K}, {f"m{k}": f"CASE WHEN p{k} IS NOT NULL THEN z{k} END" for k in _K},
    {f"q{k}": f"CASE WHEN m{k} IS NOT NULL THEN p{k} END" for k in _K} | {f"l{k}": f"CASE WHEN m{k} IS NOT NULL THEN {lag(f'y{k}')} END" for k in _K},
)
_CHOSEN = "CASE " + " ".join(f"WHEN t{k} < {CRITICAL} THEN {o}" for k, o in enumerate(ORDERS)) + " ELSE 1.0 END"
_T = "CASE " + " ".join(f"WHEN t{k} < {CRITICAL} THEN t{k}" for k in _K) + " END"


@query("stationary_order", f"WITH {SQL_BARS}, s AS (SELECT symbol, {', '.join(f'{_statistic(k)} AS t{k}' for k in _K)} FROM {steps(*_LAYERS)} GROUP BY symbol) SELECT symbol, CAST({_CHOSEN} AS DOUBLE) AS order_, round({_T}, 5) AS statistic FROM s")
def stationary_order(spark: SparkSession, d: str) -> DataFrame:
    """The smallest order of fractional differencing from which on a symbol's logarithms pass a unit-root regression; all orders in one pass of sums."""
    rows = bars(spark, d)
    for layer in _LAYERS:
        rows = rows.selectExpr("*", *(f"{x} AS {n}" for n, x in layer.items()))
    told = rows.groupBy("symbol").agg(*[F.expr(_statistic(k)).alias(f"t{k}") for k in _K])
    return told.select("symbol", F.expr(_CHOSEN).cast("double").alias("order_"), F.round(F.expr(_T), 5).alias("statistic"))

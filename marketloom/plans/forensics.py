"""The manipulation score with all eight indices, over quarterly statements a year apart.

Statements are sums over a symbol's trades of a quarter, which stand for the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.plans.catalog import query
from marketloom.sources.tables import SQL_STOCKS, load, stocks

ITEMS = {
    "revenue": "sum(l_extendedprice)", "receivables": "sum(l_extendedprice * l_tax)", "cost": "sum(l_extendedprice * (0.5 + l_discount))", "current_assets": "sum(l_extendedprice * (0.4 + l_tax))", "plant": "sum(l_extendedprice * (0.2 + l_discount))",
    "assets": "sum(l_extendedprice) * 1.2 + 1000", "depreciation": "sum(l_quantity * 20)", "overhead": "sum(l_quantity * (30 + 100 * l_discount))", "debt": "sum(l_extendedprice * (l_discount + 0.3))",
    "income": "sum(l_extendedprice * (l_discount - 0.03))", "cash_flow": "sum(l_extendedprice * (l_tax - 0.02))",
}
#: The published weights with eight and with five indices, the score from which a symbol fails, and how far ratios count.
EIGHT = {"dsri": 0.920, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}
FIVE = {"dsri": 0.823, "gmi": 0.906, "aqi": 0.593, "sgi": 0.717, "depi": 0.107}
CONSTANT_EIGHT, CONSTANT_FIVE, FAILS = -4.84, -6.065, -1.78
LEAST, MOST = 0.1, 10
#: Sectors whose statements the score doesn't suit.
EXEMPT = ("NATION_0", "NATION_7", "NATION_14")


def _against(now: str) -> str:
    """What an expression of items is to what it was a year before; null where that was nothing."""
    last = now
    for item in ITEMS:
        last = last.replace(f"[{item}]", f"{item}4")
        now = now.replace(f"[{item}]", item)
    return f"CASE WHEN abs({last}) > 1e-12 THEN ({now}) / ({last}) END"


_SOFT = "(1 - ([current_assets] + [plant]) / [assets])"
INDICES = {
    "dsri": _against("([receivables] / [revenue])"), "gmi": _against("(([revenue] - [cost]) / [revenue])"), "aqi": _against(_SOFT), "sgi": _against("[revenue]"),
    "depi": _against("([depreciation] / ([depreciation] + [plant]))"), "sgai": _against("([overhead] / [revenue])"), "lvgi": _against("([debt] / [assets])"),
}
# Margins and depreciation count the other way round: last year's over this year's.
for _name in ("gmi", "depi"):
    INDICES[_name] = f"1 / nullif({INDICES[_name]}, 0)"
INDICES["tata"] = "(income - cash_flow) / nullif(assets, 0)"
_KEPT = {n: n if n == "tata" else f"greatest({LEAST}, least({MOST}, {n}))" for n in INDICES}
_score = lambda constant, of: f"{constant} + " + " + ".join(f"({w}) * {_KEPT[n]}" for n, w in of.items())
_whole = " AND ".join(f"{n} IS NOT NULL" for n in EIGHT)
_some = " AND ".join(f"{n} IS NOT NULL" for n in FIVE)
SCORE = f"CASE WHEN {_whole} THEN {_score(CONSTANT_EIGHT, EIGHT)} WHEN {_some} THEN {_score(CONSTANT_FIVE, FIVE)} END"
MODEL = f"CASE WHEN sector IN ({', '.join(repr(s) for s in EXEMPT)}) THEN 'exempt' WHEN {_whole} THEN '8-variable' WHEN {_some} THEN '5-variable' ELSE 'none' END"
STATUS = f"CASE model WHEN 'exempt' THEN 'PASS' WHEN 'none' THEN 'UNKNOWN' ELSE CASE WHEN score > {FAILS} THEN 'FAIL' ELSE 'PASS' END END"
# Adding nothing turns a negative zero into a plain one.
_OUT = [f"round({n}, 5) + 0 AS {n}" for n in EIGHT]


@query(
    "beneish_eight",
    f"""WITH {SQL_STOCKS}, q AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, {", ".join(f"{x} AS {n}" for n, x in ITEMS.items())} FROM lineitem GROUP BY ALL),
l AS (SELECT *, {", ".join(f"lag({n}, 4) OVER w AS {n}4" for n in ITEMS)} FROM q WINDOW w AS (PARTITION BY symbol ORDER BY period)),
i AS (SELECT l.symbol, period, sector, {", ".join(f"{x} AS {n}" for n, x in INDICES.items())} FROM l JOIN stocks ON stocks.symbol = l.symbol), s AS (SELECT *, {SCORE} AS raw, {MODEL} AS model FROM i), t AS (SELECT *, CASE WHEN model <> 'exempt' THEN raw END AS score FROM s)
SELECT symbol, period, {", ".join(_OUT)}, model, round(score, 5) AS score, {STATUS} AS status FROM t""",
    dates=("period",),
)
def beneish_eight(spark: SparkSession, d: str) -> DataFrame:
    """Each quarter's indices against the year before, the score by as many as there are, and what it says; some sectors are exempt."""
    q = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("period")).agg(*[F.expr(x).alias(n) for n, x in ITEMS.items()])
    l = q.selectExpr("*", *(f"lag({n}, 4) OVER (PARTITION BY symbol ORDER BY period) AS {n}4" for n in ITEMS))
    i = l.join(stocks(spark, d).select("symbol", "sector"), "symbol").selectExpr("symbol", "period", "sector", *(f"{x} AS {n}" for n, x in INDICES.items()))
    s = i.selectExpr("*", f"{SCORE} AS raw", f"{MODEL} AS model").selectExpr("*", "CASE WHEN model <> 'exempt' THEN raw END AS score")
    return s.selectExpr("symbol", "period", *_OUT, "model", "round(score, 5) AS score", f"{STATUS} AS status")

"""Zigzags, and chart shapes over their points: tops and bottoms, heads and shoulders, boxes, triangles, wedges, harmonic and five-wave moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import recursive
from marketloom.operators.shapes import Shape, leg, longest, matched, near, ratio, signed, windows, within
from marketloom.plans.catalog import query
from marketloom.sources.tables import SQL_BARS, bars

#: The way back that makes a turning point, and how far two levels may lie apart.
TURN, LEVEL, FLAT = 0.04, 0.045, 0.015
#: Harmonic moves by their published ratios: AB to XA and AD to XA, each from and to; BC is 0.382 to 0.886 of AB.
HARMONIC = {"GARTLEY": (0.568, 0.668, 0.736, 0.836), "BAT": (0.332, 0.55, 0.836, 0.936), "BUTTERFLY": (0.736, 0.836, 1.22, 1.668), "CRAB": (0.332, 0.668, 1.568, 1.668)}
_NECK = "(p2 + p4) / 2"


def _harmonic(ab_low: float, ab_high: float, ad_low: float, ad_high: float) -> str:
    """X is the first point, D the fifth."""
    return " AND ".join([within(ratio(leg(2, 3), leg(1, 2)), ab_low, ab_high), within(ratio(leg(3, 4), leg(2, 3)), 0.382, 0.886), within(ratio(leg(2, 5), leg(1, 2)), ad_low, ad_high)])


SHAPES = [
    Shape("DOUBLE_TOP", "DOUBLE_BOTTOM", 3, near("p1", "p3", LEVEL), "p2 - (greatest(p1, p3) - p2)"),
    Shape("TRIPLE_TOP", "TRIPLE_BOTTOM", 5, f"{near('p1', 'p3', LEVEL)} AND {near('p1', 'p5', LEVEL)}", "least(p2, p4) - (greatest(p1, p3, p5) - least(p2, p4))"),
    Shape("HEAD_SHOULDERS", "INVERSE_HEAD_SHOULDERS", 5, "p3 > p1 AND p3 > p5", f"{_NECK} - (p3 - {_NECK})"),
    Shape("BOX_FROM_TOP", "BOX_FROM_BOTTOM", 4, f"{near('p1', 'p3', LEVEL)} AND {near('p2', 'p4', LEVEL)}"),
    Shape("TRIANGLE_FROM_TOP", "TRIANGLE_FROM_BOTTOM", 4, "p3 < p1 AND p4 > p2"),
    Shape("ASCENDING_TRIANGLE", "DESCENDING_TRIANGLE", 4, f"{near('p1', 'p3', FLAT)} AND p4 > p2 AND NOT {near('p2', 'p4', FLAT)}", "p3 + (p3 - p2)"),
    Shape("RISING_WEDGE", "FALLING_WEDGE", 4, "p3 > p1 AND p4 > p2 AND p4 - p2 > p3 - p1", "p2"),
    # A move down in five waves begins with a high.
    Shape("FIVE_WAVES_DOWN", "FIVE_WAVES_UP", 6, f"p3 < p1 AND p4 < p2 AND p5 < p2 AND p6 < p4 AND {leg(3, 4)} >= least({leg(1, 2)}, {leg(5, 6)})"),
    *[Shape(f"{name}_FROM_TOP", f"{name}_FROM_BOTTOM", 5, _harmonic(*shares)) for name, shares in HARMONIC.items()],
]

SQL_POINTS = f"""{SQL_BARS}, n AS (SELECT symbol, date, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS size FROM bars),
z AS (SELECT symbol, k, size, date AS spot, close AS price, 0 AS way, false AS turned, CAST(NULL AS DATE) AS old_spot, CAST(NULL AS DOUBLE) AS old_price, CAST(NULL AS INT) AS old_way FROM n WHERE k = 1
UNION ALL SELECT x.symbol, x.k, x.size, CASE WHEN move <> 0 THEN x.date ELSE x.spot END, CASE move WHEN 1 THEN high WHEN 2 THEN high WHEN -1 THEN low WHEN -2 THEN low ELSE price END, CASE WHEN move > 0 THEN 1 WHEN move < 0 THEN -1 ELSE way END, abs(move) = 2, x.spot, x.price, x.way
  FROM (SELECT n.symbol, n.k, n.size, n.date, n.high, n.low, z.spot, z.price, z.way, CASE WHEN z.way >= 0 AND n.high > z.price THEN 1 WHEN z.way <= 0 AND n.low < z.price THEN -1 WHEN z.way >= 0 AND (z.price - n.low) / z.price >= {TURN} THEN -2 WHEN z.way <= 0 AND (n.high - z.price) / z.price >= {TURN} THEN 2 ELSE 0 END AS move
    FROM z JOIN n ON n.symbol = z.symbol AND n.k = z.k + 1) x),
points AS (SELECT symbol, date, price, way, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS point FROM (
  SELECT symbol, old_spot AS date, old_price AS price, old_way AS way FROM z WHERE turned UNION ALL SELECT symbol, spot, price, way FROM z WHERE k = size))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """symbol, date (of the bar the point lies in), point, price and way."""
    return recursive.zigzag(bars(spark, d), "symbol", "date", TURN)


@query("zigzag_points", f"WITH RECURSIVE {SQL_POINTS} SELECT symbol, date, point, round(price, 6) AS price, CAST(way AS BIGINT) AS way FROM points", dates=("date",))
def zigzag_points(spark: SparkSession, d: str) -> DataFrame:
    """The turning points of each symbol, with the last point so far."""
    return points(spark, d).withColumn("price", F.round("price", 6))


def _matches() -> str:
    parts = []
    for s in SHAPES:
        for name, way in ((s.name, 1), (s.mirrored, -1)):
            target = f"{way} * ({signed(s.target, s.points, way)})" if s.target != "NULL" else "CAST(NULL AS DOUBLE)"
            parts.append(f"SELECT symbol, '{name}' AS shape, d1 AS first, d{s.points} AS last, round({target}, 5) AS target FROM w WHERE {s.condition(way)}")
    return " UNION ALL ".join(parts)


@query("chart_shapes", f"WITH RECURSIVE {SQL_POINTS}, w AS (SELECT symbol, {', '.join(f'{x} AS {n}' for n, x in windows('symbol', 'point', longest(SHAPES)).items())} FROM points) {_matches()}", dates=("first", "last"))
def chart_shapes(spark: SparkSession, d: str) -> DataFrame:
    """All shapes in the turning points of each symbol, with the price a shape points to."""
    return matched(points(spark, d), "symbol", "point", SHAPES).withColumn("target", F.round("target", 5))

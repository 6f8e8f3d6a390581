"""Shapes in a sequence of turning points, by one matcher.

A shape looks at so many points in a row and says what must hold of their prices, for the
kind that begins with a high. Its mirror image begins with a low: the same conditions on
negated prices. Conditions are SQL text over p1, p2, ..., and a target may be told.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    name: str
    mirrored: str
    points: int
    holds: str
    target: str = "NULL"

    def condition(self, way: int) -> str:
        return signed(f"p1w = {way} AND ({self.holds})", self.points, way)


def signed(sql: str, points: int, way: int) -> str:
    """The text over prices as they are, or negated."""
    if way > 0:
        return sql
    for k in range(1, points + 1):
        sql = sql.replace(f"p{k}w", f"@{k}w").replace(f"p{k}", f"(-@{k})").replace(f"@{k}", f"p{k}")
    return sql


def longest(shapes: list[Shape]) -> int:
    return max(s.points for s in shapes)


def near(a: str, b: str, share: float) -> str:
    return f"abs({a} - {b}) < {share} * abs({a})"


def within(x: str, low: float, high: float) -> str:
    return f"{x} BETWEEN {low} AND {high}"


def leg(a: int, b: int) -> str:
    return f"abs(p{b} - p{a})"


def ratio(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


def windows(key: str, order: str, points: int, price: str = "price", way: str = "way", at: str = "date") -> dict[str, str]:
    """Columns p1, d1, p2, d2, ... of a point and those after it, and p1w, the first one's kind."""
    ahead = lambda c, k: f"lead({c}, {k}) OVER (PARTITION BY {key} ORDER BY {order})" if k else c
    return {f"p{k + 1}": ahead(price, k) for k in range(points)} | {f"d{k + 1}": ahead(at, k) for k in range(points)} | {"p1w": way}


def matched(points: DataFrame, key: str, order: str, shapes: list[Shape]) -> DataFrame:
    """key, shape, first, last (dates of its points) and target, a row per match; ``points`` has price, way and date, and highs and lows take turns."""
    wide = points.withColumns({n: F.expr(x) for n, x in windows(key, order, longest(shapes)).items()})
    rows = []
    for s in shapes:
        for name, way in ((s.name, 1), (s.mirrored, -1)):
            target = f"{way} * ({signed(s.target, s.points, way)})" if s.target != "NULL" else "CAST(NULL AS DOUBLE)"
            told = F.struct(F.lit(name).alias("shape"), F.col("d1").alias("first"), F.col(f"d{s.points}").alias("last"), F.expr(target).alias("target"))
            rows.append(F.when(F.expr(s.condition(way)), told))
    each = wide.select(key, F.explode(F.array_compact(F.array(*rows))).alias("m"))
    return each.select(key, "m.*")

"""The normal distribution as column expressions, which Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rational approximation 7.1.26 of Abramowitz and Stegun, within 1.5e-7.
P, TERMS = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + P * x)
    series = F.lit(0.0)
    for a in reversed(TERMS):
        series = (series + a) * t
    tail = series * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def sql_normal_cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + {P} * {x}))"
    series = "0.0"
    for a in reversed(TERMS):
        series = f"(({series} + {a}) * {t})"
    tail = f"({series} * exp(-{x} * {x}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"

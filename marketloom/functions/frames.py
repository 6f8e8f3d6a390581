"""Window helpers over series of a key in order of a time column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str | list[str], *order: str) -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(*order)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, Window.currentRow)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate of the last ``n`` rows; null until ``n`` of them have values."""
    frame = last_n(w, n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """Relative change against ``n`` rows before; null where that is null or 0."""
    before = F.lag(x, n).over(w)
    return F.when(before != 0, x / before - 1)


def island(flag: Column, w: WindowSpec) -> Column:
    """Numbers runs of true: each false begins a new island, to whose number the trues after it belong."""
    return F.sum(F.when(flag, 0).otherwise(1)).over(so_far(w))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))

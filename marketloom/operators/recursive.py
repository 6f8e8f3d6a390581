"""Indicators that carry state from bar to bar, for all keys of a batch at once.

Keys are dealt over a stated number of tasks. In a task, the series of many keys lie side
by side as columns of matrices with a row per bar, and a recursion is one numpy step per
bar over all of them, whatever their number. A key's series is held whole: it has a few
thousand bars. Series of one matrix come in order of their keys; a matrix has ``CELLS``
cells at most, or one series. Missing values are NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a matrix.
CELLS = 1 << 20
#: Columns of matrices in, named matrices out; rows where all outputs are NaN stay.
Step = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def _panels(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole series, and the number of bars of each, from batches sorted by key and order."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table, last: bool) -> tuple[list[tuple[pa.Table, np.ndarray]], pa.Table]:
        codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        borders = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
        whole = len(borders) - (1 if last else 2)  # the last series may go on
        out, i = [], 0
        sizes = np.diff(borders)
        while i < whole:
            j, longest = i, 0
            while j < whole and (j == i or max(longest, sizes[j]) * (j - i + 1) <= CELLS):
                longest = max(longest, int(sizes[j]))
                j += 1
            out.append((table.slice(borders[i], borders[j] - borders[i]), sizes[i:j]))
            i = j
        return out, table.slice(borders[max(whole, 0)])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows > CELLS // 4:
                done, rest = cut(pa.Table.from_batches(held), False)
                yield from done
                held = rest.combine_chunks().to_batches()
                rows = rest.num_rows
    if held:
        yield from cut(pa.Table.from_batches(held), True)[0]


def _matrix(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full((int(sizes.max()), len(sizes)), np.nan)
    out[_places(sizes)] = values
    return out


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each bar."""
    column = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column


def _spread(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows by key and order; the number of tasks is stated, so that small series aren't gathered in few."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.select(key, order, *columns).repartition(n, key).sortWithinPartitions(key, order)


def per_bar(df: DataFrame, key: str, order: str, columns: list[str], fn: Step, schema: str) -> DataFrame:
    """key, order and the matrices that ``fn`` makes of ``columns`` and the series' lengths, a row per bar; ``schema`` names them."""
    kinds, names = dict(df.dtypes), [c.split()[0] for c in schema.split(", ")]
    whole = {c.split()[0] for c in schema.split(", ") if c.split()[1] == "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _panels(batches, key):
            at = _places(sizes)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                made = fn({c: _matrix(table[c].to_numpy().astype(float), sizes) for c in columns}, sizes)
            out = [table[key].combine_chunks(), table[order].combine_chunks()]
            for n in names:
                values = made[n][at]
                out.append(pa.array(values.astype(np.int64)) if n in whole else pa.array(values, from_pandas=True))
            yield pa.RecordBatch.from_arrays(out, names=[key, order, *names])

    return _spread(df, key, order, columns).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}")


def per_event(df: DataFrame, key: str, order: str, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """Rows that a series gives now and then: ``fn`` returns (bar, series) of each, in order, and its columns."""
    kinds, names = dict(df.dtypes), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _panels(batches, key):
            with np.errstate(divide="ignore", invalid="ignore"):
                bar, series, made = fn({c: _matrix(table[c].to_numpy().astype(float), sizes) for c in columns}, sizes)
            by = np.lexsort((np.arange(len(bar)), series))
            at = pa.array(((np.cumsum(sizes) - sizes)[series] + bar)[by])
            heads = [table[c].combine_chunks().take(at) for c in (key, order)]
            yield pa.RecordBatch.from_arrays([*heads, *(pa.array(made[n][by]) for n in names)], names=[key, order, *names])

    return _spread(df, key, order, columns).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}")


def numbered(series: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for the events of each series, in the order they come."""
    order = np.argsort(series, kind="stable")
    place = np.empty(len(series), np.int64)
    place[order] = np.arange(len(series)) - np.searchsorted(series[order], series[order])
    return place


def before(x: np.ndarray, n: int = 1) -> np.ndarray:
    """The values ``n`` bars before."""
    out = np.full_like(x, np.nan)
    out[n:] = x[: len(x) - n] if n < len(x) else x[:0]
    return out


def seeded(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """An exponential mean seeded by the plain mean of the first ``n`` values; NaN before, and where ``x`` is."""
    out = np.full_like(x, np.nan)
    count, total, value = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(len(x)):
        own = ~np.isnan(x[t])
        count += own
        early = own & (count <= n)
        total[early] += x[t][early]
        value = np.where(own & (count == n), total / n, np.where(own & (count > n), value + alpha * (x[t] - value), value))
        out[t] = np.where(own & (count >= n), value, np.nan)
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 2 / (n + 1))


def rma(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 1 / n)


def span_mean(x: np.ndarray, n: int) -> np.ndarray:
    """The exponential mean of span ``n`` that begins with the first value."""
    return seeded(x, 1, 2 / (n + 1))


def rolled(x: np.ndarray, n: int, fn: Callable) -> np.ndarray:
    """``fn`` (over an axis) of the last ``n`` values; NaN until there are so many, or if one is."""
    out = np.full_like(x, np.nan)
    if len(x) >= n:
        out[n - 1 :] = fn(np.lib.stride_tricks.sliding_window_view(x, n, axis=0), axis=-1)
    return out


def mean_of(df: DataFrame, key: str, order: str, x: str, n: int, name: str, also: list[str]) -> DataFrame:
    """The exponential mean ``name`` of ``x``, beside ``x`` and other numeric columns."""
    columns = [x, *also]
    return per_bar(df, key, order, columns, lambda c, _: {**c, name: ema(c[x], n)}, ", ".join(f"{c} double" for c in (*columns, name)))


def macd(df: DataFrame, key: str, order: str, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Means are seeded by the first value."""

    def fn(c: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        line = span_mean(c[x], fast) - span_mean(c[x], slow)
        # The signal's mean starts from 0, as the first difference is.
        smooth = span_mean(line, signal)
        return {"macd": line, "signal": smooth, "histogram": line - smooth}

    return per_bar(df, key, order, [x], fn, "macd double, signal double, histogram double")


def heikin_ashi(df: DataFrame, key: str, order: str) -> DataFrame:
    def fn(c: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        close = (c["open"] + c["high"] + c["low"] + c["close"]) / 4
        # Each open is the middle of the last open and close: a mean of closes that starts from the first bar's own middle.
        opened = span_mean(np.concatenate([((c["open"] + c["close"]) / 2)[:1], close[:-1]]), 3)
        return {"ha_open": opened, "ha_high": np.maximum(np.maximum(c["high"], opened), close), "ha_low": np.minimum(np.minimum(c["low"], opened), close), "ha_close": close}

    return per_bar(df, key, order, ["open", "high", "low", "close"], fn, "ha_open double, ha_high double, ha_low double, ha_close double")


def rsi_wilder(df: DataFrame, key: str, order: str, x: str, n: int) -> DataFrame:
    def fn(c: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        step = c[x] - before(c[x])
        gain, loss = rma(np.maximum(step, 0), n), rma(np.maximum(-step, 0), n)
        return {"rsi": np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))}

    return per_bar(df, key, order, [x], fn, "rsi double")


def true_range(c: dict[str, np.ndarray]) -> np.ndarray:
    last = before(c["close"])
    return np.fmax(c["high"] - c["low"], np.fmax(np.abs(c["high"] - last), np.abs(c["low"] - last)))


def supertrend(df: DataFrame, key: str, order: str, n: int, factor: float) -> DataFrame:
    def fn(c: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        close, atr = c["close"], rma(true_range(c), n)
        middle = (c["high"] + c["low"]) / 2
        upper, lower = middle + factor * atr, middle - factor * atr
        line, trend = np.full_like(close, np.nan), np.zeros_like(close)
        for t in range(n - 1, len(close)):
            last = np.ones(close.shape[1])
            if t > n - 1:
                last = trend[t - 1]
                upper[t] = np.where((upper[t] > upper[t - 1]) & (close[t - 1] <= upper[t - 1]), upper[t - 1], upper[t])
                lower[t] = np.where((lower[t] < lower[t - 1]) & (close[t - 1] >= lower[t - 1]), lower[t - 1], lower[t])
            trend[t] = np.where(close[t] > upper[t], 1, np.where(close[t] < lower[t], -1, last))
            line[t] = np.where(trend[t] > 0, lower[t], upper[t])
        return {"supertrend": line, "trend": np.where(np.isnan(line), 0, trend)}

    return per_bar(df, key, order, ["high", "low", "close"], fn, "supertrend double, trend long")


def kama(df: DataFrame, key: str, order: str, x: str, n: int, fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman's mean: faster the straighter the series ran."""

    def fn(c: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        v = c[x]
        out = np.full_like(v, np.nan)
        way = rolled(np.abs(v - before(v)), n, np.sum)
        ratio = np.where(way > 0, np.abs(v - before(v, n)) / way, 0.0)
        rate = (ratio * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
        for t in range(n, len(v)):
            out[t] = v[t] if t == n else out[t - 1] + rate[t] * (v[t] - out[t - 1])
        return {"kama": out}

    return per_bar(df, key, order, [x], fn, "kama double")


def renko(df: DataFrame, key: str, order: str, x: str, share: float) -> DataFrame:
    """Bricks of ``share`` of the first value, on a grid that begins there; a turn needs two bricks."""

    def fn(c: dict[str, np.ndarray], _: np.ndarray):
        v = c[x]
        box = v[0] * share
        top = bottom = np.zeros(v.shape[1])
        bars, series, lows, ways = ([np.zeros(0, np.int64)] for _ in range(4))
        for t in range(len(v)):
            place = (v[t] - v[0]) / box
            high, low = np.floor(place + 1e-9), np.ceil(place - 1e-9)
            ups, downs = np.where(high > top, high - top, 0), np.where(low < bottom, bottom - low, 0)
            for n, first, way in ((ups, top, 1), (downs, bottom - 1, -1)):
                n = np.nan_to_num(n).astype(np.int64)
                own = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                bars.append(np.full(len(own), t))
                series.append(own)
                lows.append((first[own] + way * k).astype(np.int64))
                ways.append(np.full(len(own), way))
            top, bottom = np.where(ups > 0, high, np.where(downs > 0, low + 1, top)), np.where(ups > 0, high - 1, np.where(downs > 0, low, bottom))
        bar, series, lows, ways = (np.concatenate(a) for a in (bars, series, lows, ways))
        first, size = v[0][series], box[series]
        opened, closed = lows + (ways < 0), lows + (ways > 0)
        return bar, series, {"brick": numbered(series), "brick_open": first + opened * size, "brick_close": first + closed * size, "direction": ways}

    return per_event(df, key, order, [x], fn, "brick long, brick_open double, brick_close double, direction long")


def smoothed(df: DataFrame, key: str, order: str) -> DataFrame:
    """The indicators of a chart that rest on exponential means, all in one pass over the series."""
    names = ("ema20", "smma14", "dema20", "tema20", "zlema20", "atr14", "efi13", "bull_bear13", "chaikin", "ppo", "trix", "tsi", "mass", "ema14")

    def fn(x: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        c, h, l, v = (x[k] for k in ("close", "high", "low", "volume"))
        step = c - before(c)
        e1 = ema(c, 20)
        e2 = ema(e1, 20)
        flow = np.cumsum(np.where(h > l, ((c - l) - (h - c)) / np.where(h > l, h - l, 1.0), 0.0 * c) * v, axis=0)
        fast, slow = ema(c, 12), ema(c, 26)
        triple = ema(ema(ema(c, 15), 15), 15)
        width = ema(h - l, 9)
        ahead = c - before(c, 9)
        return {
            "ema20": e1, "smma14": rma(c, 14), "dema20": 2 * e1 - e2, "tema20": 3 * (e1 - e2) + ema(e2, 20), "zlema20": ema(c + np.where(np.isnan(ahead), 0, ahead), 20),
            "atr14": rma(true_range(x), 14), "efi13": ema(step * v, 13), "bull_bear13": h + l - 2 * ema(c, 13), "chaikin": ema(flow, 3) - ema(flow, 10), "ppo": (fast - slow) / slow * 100,
            "trix": (triple / before(triple) - 1) * 100, "tsi": 100 * ema(ema(step, 25), 13) / ema(ema(np.abs(step), 25), 13), "mass": rolled(width / ema(width, 9), 25, np.sum), "ema14": ema(c, 14),
        }

    return per_bar(df, key, order, ["high", "low", "close", "volume"], fn, ", ".join(f"{n} double" for n in names))


def first_seeded(df: DataFrame, key: str, order: str) -> DataFrame:
    """Exponential means and deviations that begin with the first value."""
    spans = (5, 12, 26, 200)

    def deviation(x: np.ndarray, n: int) -> np.ndarray:
        """With the correction for the weights' own squares."""
        alpha = 2 / (n + 1)
        mean, square = span_mean(x, n), span_mean(x * x, n)
        seen = np.cumsum(~np.isnan(x), axis=0)
        ones = 1 - alpha
        # The sum of squared weights after so many values, the first of which has the rest of the weight.
        weight = ones ** (2.0 * (seen - 1)) + alpha * alpha * (1 - ones ** (2.0 * (seen - 1))) / (1 - ones * ones)
        return np.sqrt(np.where(seen > 1, np.maximum(0, square - mean * mean) / (1 - weight), np.nan))

    def fn(c: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        change = c["close"] / before(c["close"]) - 1
        return {f"ema{n}": span_mean(c["close"], n) for n in spans} | {f"volatility_ewma{n}": deviation(change, n) * np.sqrt(252) * 100 for n in (20, 60)}

    return per_bar(df, key, order, ["close"], fn, ", ".join([*(f"ema{n} double" for n in spans), "volatility_ewma20 double", "volatility_ewma60 double"]))


def adaptive(df: DataFrame, key: str, order: str) -> DataFrame:
    """McGinley's mean of 14, the Fisher transform of 9, and the indices of falling and rising volume: a state from bar to bar."""

    def fn(x: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        c, v, middle = x["close"], x["volume"], (x["high"] + x["low"]) / 2
        top, bottom = rolled(middle, 9, np.max), rolled(middle, 9, np.min)
        raw = np.where(top > bottom, ((middle - bottom) / (top - bottom) - 0.5) * 2, 0.0)
        mg, fish, nvi, pvi = np.full_like(c, np.nan), np.full_like(c, np.nan), np.full_like(c, 1000.0), np.full_like(c, 1000.0)
        mg[0], held, last = c[0], np.zeros(c.shape[1]), np.zeros(c.shape[1])
        for t in range(1, len(c)):
            mg[t] = mg[t - 1] + (c[t] - mg[t - 1]) / (14 * np.clip(c[t] / mg[t - 1], 0.25, 4.0) ** 4)
            step = c[t] / c[t - 1]
            nvi[t], pvi[t] = nvi[t - 1] * np.where(v[t] < v[t - 1], step, 1), pvi[t - 1] * np.where(v[t] > v[t - 1], step, 1)
            if t >= 8:
                held = np.clip(0.33 * raw[t] + 0.67 * held, -0.999, 0.999)
                last = 0.5 * np.log((1 + held) / (1 - held)) + 0.5 * last
                fish[t] = last
        return {"mcginley14": mg, "fisher9": fish, "nvi": nvi, "pvi": pvi}

    return per_bar(df, key, order, ["high", "low", "close", "volume"], fn, "mcginley14 double, fisher9 double, nvi double, pvi double")


def trailing(df: DataFrame, key: str, order: str, start: float = 0.02, most: float = 0.2) -> DataFrame:
    """A stop that trails the extreme (psar), means that adapt or are smoothed six times (vidya14, t3), and oscillators of volume force and of the relative strength."""

    def stop(x: dict[str, np.ndarray]) -> np.ndarray:
        high, low, close = x["high"], x["low"], x["close"]
        out = np.full_like(close, np.nan)
        if len(close) < 2:
            return out
        # Seen from the side of the position, prices are negated for a short one: best is where the extreme moves, worst where the stop waits.
        side = np.where(close[1] >= close[0], 1.0, -1.0)
        view = lambda t: (np.where(side > 0, high[t], -low[t]), np.where(side > 0, low[t], -high[t]))
        extreme, at = view(0)
        pace = np.full(close.shape[1], start)
        for t in range(1, len(close)):
            out[t] = at * side
            best, worst = view(t)
            hit, further = worst < at, best > extreme
            faster = np.where(further, np.minimum(most, pace + start), pace)
            ahead = np.maximum(extreme, best)
            moved = at + faster * (ahead - at)
            if t >= 2:
                moved = np.minimum(moved, np.minimum(view(t - 1)[1], view(t - 2)[1]))
            at, extreme, pace, side = np.where(hit, -extreme, moved), np.where(hit, -worst, ahead), np.where(hit, start, faster), np.where(hit, -side, side)
        return np.where(np.isnan(close), np.nan, out)

    def fn(x: dict[str, np.ndarray], _: np.ndarray) -> dict[str, np.ndarray]:
        c, typical = x["close"], (x["high"] + x["low"] + x["close"]) / 3
        step = c - before(c)
        way = rolled(np.abs(step), 14, np.sum)
        share = np.where(way > 0, np.abs(c - before(c, 14)) / way, 0.0) * 2 / 15
        adapted = np.full_like(c, np.nan)
        for t in range(14, len(c)):
            adapted[t] = c[t] if t == 14 else adapted[t - 1] + share[t] * (c[t] - adapted[t - 1])
        e = [ema(c, 8)]
        for _ in range(5):
            e.append(ema(e[-1], 8))
        v = 0.7
        t3 = -(v**3) * e[5] + 3 * v * v * (1 + v) * e[4] - 3 * v * (1 + v) ** 2 * e[3] + (1 + v) ** 3 * e[2]
        trend = np.where(typical > before(typical), 1.0, -1.0)
        trend[0] = 1.0
        force = x["volume"] * trend * np.where(trend == before(trend), 1.4, 0.8) * np.maximum(1e-4, x["high"] - x["low"]) / np.maximum(1, c) * 100
        force[0] = np.nan
        klinger = ema(force, 34) - ema(force, 55)
        gain, loss = rma(np.maximum(step, 0), 14), rma(np.maximum(-step, 0), 14)
        rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        top, bottom = rolled(rsi, 14, np.max), rolled(rsi, 14, np.min)
        raw = np.where(np.isnan(top), np.nan, np.where(top > bottom, (rsi - bottom) / (top - bottom) * 100, 50.0))
        k = rolled(raw, 3, np.mean)
        return {"psar": stop(x), "vidya14": adapted, "t3": t3, "klinger": klinger, "klinger_signal": ema(klinger, 13), "stoch_rsi_k": k, "stoch_rsi_d": rolled(k, 3, np.mean)}

    return per_bar(df, key, order, ["high", "low", "close", "volume"], fn, ", ".join(f"{n} double" for n in ("psar", "vidya14", "t3", "klinger", "klinger_signal", "stoch_rsi_k", "stoch_rsi_d")))


def line_break(df: DataFrame, key: str, order: str, n: int = 3) -> DataFrame:
    """Lines of closes: one goes on in its direction, or turns beyond the last ``n`` lines."""

    def fn(x: dict[str, np.ndarray], _: np.ndarray):
        o, c = x["open"], x["close"]
        from_, to = o[0].copy(), c[0].copy()
        # Both ends of the last lines; before there are so many, the first stands for them.
        ends = [(from_, to)] * n
        bars, series, opened, closed = [np.zeros(c.shape[1], np.int64)], [np.arange(c.shape[1])], [from_], [to]
        for t in range(1, len(c)):
            top, bottom = np.maximum.reduce([e for line in ends for e in line]), np.minimum.reduce([e for line in ends for e in line])
            up = to >= from_
            goes, turns = np.where(up, c[t] > to, c[t] < to), np.where(up, c[t] < bottom, c[t] > top)
            new = goes | turns
            from_, to = np.where(goes, to, from_), np.where(new, c[t], to)
            ends = [(np.where(new, a, b), np.where(new, p, q)) for (a, p), (b, q) in zip([(from_, to), *ends[:-1]], ends, strict=True)]
            own = np.flatnonzero(new)
            bars.append(np.full(len(own), t))
            series.append(own)
            opened.append(from_[own])
            closed.append(to[own])
        series = np.concatenate(series)
        return np.concatenate(bars), series, {"line": numbered(series), "line_open": np.concatenate(opened), "line_close": np.concatenate(closed)}

    return per_event(df, key, order, ["open", "close"], fn, "line long, line_open double, line_close double")


def kagi(df: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """Segments that end where the close turns by ``share`` of the first close or more."""

    def fn(x: dict[str, np.ndarray], sizes: np.ndarray):
        c = x["close"]
        bars, series, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        if len(c) > 1:
            turn, way, start, extreme = c[0] * share, np.where(c[1] >= c[0], 1, -1), c[0].copy(), c[1].copy()
            for t in range(1, len(c)):
                on = (c[t] - extreme) * way >= 0
                turns = ~on & ((extreme - c[t]) * way >= turn)
                own = np.flatnonzero(turns)
                bars.append(np.full(len(own), t))
                series.append(own)
                starts.append(start[own])
                ends.append(extreme[own])
                start, way = np.where(turns, extreme, start), np.where(turns, -way, way)
                extreme = np.where(on | turns, c[t], extreme)
                last = np.flatnonzero(sizes == t + 1)
                bars.append(np.full(len(last), t))
                series.append(last)
                starts.append(start[last])
                ends.append(extreme[last])
        series = np.concatenate(series)
        return np.concatenate(bars), series, {"segment": numbered(series), "start": np.concatenate(starts), "end": np.concatenate(ends)}

    return per_event(df, key, order, ["close"], fn, "segment long, start double, end double")


def zigzag(df: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """Turning points: highs and lows (way 1 and -1; 0 if the series never moved) from which the series came back by ``share`` or more, and its last point.

    A point moves on while the series goes further its way. The first one begins at the first close.
    """

    def fn(x: dict[str, np.ndarray], sizes: np.ndarray):
        high, low, n = x["high"], x["low"], x["close"].shape[1]
        price, at, way = x["close"][0].copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        bars, series, prices, ways = [], [], [], []

        def tell(own: np.ndarray) -> None:
            for held, new in ((bars, at[own]), (series, own), (prices, price[own]), (ways, way[own])):
                held.append(new)

        for t in range(len(high)):
            if t:
                up = (way >= 0) & (high[t] > price)
                down = ~up & (way <= 0) & (low[t] < price)
                falls = ~up & ~down & (way >= 0) & ((price - low[t]) / price >= share)
                rises = ~up & ~down & ~falls & (way <= 0) & ((high[t] - price) / price >= share)
                tell(np.flatnonzero(falls | rises))
                way = np.where(up | rises, 1, np.where(down | falls, -1, way))
                moved = up | down | falls | rises
                price = np.where(up | rises, high[t], np.where(down | falls, low[t], price))
                at = np.where(moved, t, at)
            tell(np.flatnonzero(sizes == t + 1))
        series = np.concatenate(series)
        return np.concatenate(bars), series, {"point": numbered(series), "price": np.concatenate(prices), "way": np.concatenate(ways)}

    return per_event(df, key, order, ["high", "low", "close"], fn, "point long, price double, way long")


def garch_loss(r: np.ndarray, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihoods, and the variance each foresees, of series (columns of ``r``, NaN after their end) under parameters (a row per series).

    The long-run variance is the sample's.
    """
    target = np.nanvar(r, axis=0, ddof=1)[:, None]
    base = target * (1 - alpha - beta - 0.5 * gamma)
    s, loss = np.broadcast_to(target, alpha.shape).copy(), np.zeros(alpha.shape)
    with np.errstate(invalid="ignore", divide="ignore"):
        for x in r:
            own = ~np.isnan(x)
            x = x[own][:, None]
            loss[own] += 0.5 * (np.log(s[own]) + x * x / s[own])
            s[own] = base[own] + (alpha[own] + gamma[own] * (x < 0)) * x * x + beta[own] * s[own]
    return np.where((base > 0) & (alpha + beta + 0.5 * gamma < 0.999), loss, np.inf), s


def garch(df: DataFrame, key: str, order: str, x: str, least: int = 50, periods: int = 252) -> DataFrame:
    """Asymmetric volatility (alpha, beta, gamma) of each series by likelihood on a grid that narrows, and the next period's volatility a year."""
    # Series that are searched together: each has a grid of parameters.
    together = 256

    def fn(c: dict[str, np.ndarray], sizes: np.ndarray):
        r = c[x]
        count = (~np.isnan(r)).sum(0)
        ok = count >= least
        ok[ok] = np.nanvar(r[:, ok], axis=0) >= 1e-12
        some = np.flatnonzero(ok)
        found, foresees = np.zeros((len(some), 3)), np.zeros(len(some))
        for i in range(0, len(some), together):
            own = r[:, some[i : i + together]]
            # Values come first, without the gaps between them.
            own = np.take_along_axis(own, np.argsort(np.isnan(own), axis=0, kind="stable"), 0)
            own = own - np.nanmean(own, axis=0)
            best, width = np.tile([0.05, 0.8, 0.1], (own.shape[1], 1)), np.array([0.5, 0.8, 0.5])
            for _ in range(12):
                sides = np.clip(best[:, :, None] + width[None, :, None] * np.linspace(-1, 1, 7), 0, 1)
                a, b, g = np.meshgrid(*[np.arange(7)] * 3)
                grid = np.stack([sides[:, k, p.ravel()] for k, p in enumerate((a, b, g))], 1)
                grid = np.concatenate([best[:, :, None], grid], 2)
                loss, after = garch_loss(own, grid[:, 0], grid[:, 1], grid[:, 2])
                k = loss.argmin(1)
                rows = np.arange(len(k))
                best, ahead, width = grid[rows, :, k], after[rows, k], width * 0.6
            found[i : i + together], foresees[i : i + together] = best, ahead
        return sizes[some] - 1, some, {"alpha": found[:, 0], "beta": found[:, 1], "gamma": found[:, 2], "volatility": np.sqrt(foresees * periods)}

    return per_event(df, key, order, [x], fn, "alpha double, beta double, gamma double, volatility double")

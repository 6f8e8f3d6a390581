"""Hidden-Markov regimes of one long series, by scans over blocks.

A series (any number of rows, one order) is cut into blocks, each a row of a table. A
step of the forward pass is a small matrix; products of matrices are associative, so a
block's whole effect is one matrix, and what comes before and after a block is told by
the others' products. Within a block the running products are made by doubling, all
steps at once. So one series is worked on by as many tasks as it has blocks: the driver
sees a small matrix per block, of which there are ``BLOCKS`` at most, and sums.

Training is expectation-maximisation with Gaussian emissions of one covariance for all
states. Smoothed probabilities, the most likely path (products in which sums become
maxima) and volatilities that switch with the regime (affine steps) are scans as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.steps import written

#: Rows of a block at least, and blocks at most.
ROWS, BLOCKS = 1024, 4096
#: Added to the covariance's diagonal.
RIDGE = 1e-3


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covariance: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Log densities, a row per step and a column per state."""
        root = np.linalg.inv(np.linalg.cholesky(self.covariance))
        z = (x @ root.T)[:, None, :] - (self.means @ root.T)[None, :, :]
        return -0.5 * (z * z).sum(2) + np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)


def blocks_of(series: DataFrame, order: str, values: str, rows: int = ROWS, most: int = BLOCKS) -> DataFrame:
    """``series`` as rows block, at (list of ``order``) and x (its ``values``, as bytes): a written table, in order of blocks."""
    spark = series.sparkSession
    series = written(series.select(F.col(order).alias("at"), F.col(values).cast("array<double>").alias("x")))
    size = max(rows, -(-series.count() // most))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = series.repartitionByRange(parts, "at").sortWithinPartitions("at").withColumn("place", F.monotonically_increasing_id())
    kind = series.schema["at"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        first = None

        def block(t: pa.Table) -> pa.RecordBatch:
            x = t["x"].combine_chunks()
            at = t["at"].combine_chunks()
            at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
            lists = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), at)
            return pa.RecordBatch.from_arrays([t["place"].slice(0, 1).combine_chunks(), lists, pa.array([x.flatten().to_numpy().astype("<f8").tobytes()], pa.binary())], names=["block", "at", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch if first is None else first
            held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= size:
                whole = pa.concat_tables(held)
                yield block(whole.slice(0, size))
                held = [whole.slice(size)]
        if held and (whole := pa.concat_tables(held)).num_rows:
            yield block(whole)

    return written(sorted_.mapInArrow(cut, f"block long, at array<{kind}>, x binary"))


def _normal(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = m.max((1, 2))
    return m / top[:, None, None], np.log(top)


def products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running products of matrices, scaled, with the logarithms of their scales."""
    m, scale = _normal(m)
    step = 1
    while step < len(m):
        joint, more = _normal(m[:-step] @ m[step:])
        scale = np.r_[scale[:step], scale[:-step] + scale[step:] + more]
        m = np.concatenate([m[:step], joint])
        step *= 2
    return m, scale


def best_sums(m: np.ndarray) -> np.ndarray:
    """Running products where a product is a sum and a sum a maximum."""
    step = 1
    while step < len(m):
        joint = (m[:-step, :, :, None] + m[step:, None, :, :]).max(2)
        m = np.concatenate([m[:step], joint])
        step *= 2
    return m


def _steps(model: Model, x: np.ndarray, begins: bool) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of each step, and the logarithm that was taken out of it."""
    log = model.emissions(x)
    top = log.max(1)
    moves = np.broadcast_to(model.moves, (len(x), *model.moves.shape)).copy()
    if begins:
        moves[0] = np.eye(len(model.start))
    return moves * np.exp(log - top[:, None])[:, None, :], top


def _each(blocks: DataFrame, fn: Callable[[int, np.ndarray], dict[str, np.ndarray]], width: int, names: list[str]) -> list[dict]:
    """What ``fn`` makes of every block, in order: lists of numbers, one row per block, brought to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = fn(block, np.frombuffer(x.as_buffer(), "<f8").reshape(-1, width))
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([np.ravel(made[n]).tolist()], pa.list_(pa.float64())) for n in names)], names=["block", *names])

    schema = "block long, " + ", ".join(f"{n} array<double>" for n in names)
    rows = blocks.select("block", "x").mapInArrow(run, schema).collect()
    return [{n: np.array(r[n]) for n in names} | {"block": r["block"]} for r in sorted(rows, key=lambda r: r["block"])]


def _borders(model: Model, blocks: DataFrame, width: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], float, int]:
    """What the forward pass holds before each block, and the backward pass after it; the log-likelihood; the first block."""
    first = blocks.agg(F.min("block")).first()[0]
    k = len(model.start)

    def whole(block: int, x: np.ndarray) -> dict[str, np.ndarray]:
        m, top = _steps(model, x, block == first)
        m, scale = products(m)
        return {"m": m[-1], "scale": np.array([scale[-1] + top.sum()])}

    told = _each(blocks, whole, width, ["m", "scale"])
    before, after, now, log = {}, {}, model.start, 0.0
    for r in told:
        before[r["block"]] = now
        now = now @ r["m"].reshape(k, k)
        log += float(r["scale"][0]) + float(np.log(now.sum()))
        now = now / now.sum()
    now = np.ones(k)
    for r in reversed(told):
        after[r["block"]] = now
        now = r["m"].reshape(k, k) @ now
        now = now / now.max()
    return before, after, log, first


def _passes(model: Model, x: np.ndarray, begins: bool, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered (forward) and backward vectors of a block's steps, each scaled, and the steps' matrices."""
    m, _ = _steps(model, x, begins)
    forward = before @ products(m)[0]
    back = products(m[::-1].transpose(0, 2, 1))[0]  # suffix products, transposed
    backward = np.concatenate([(after @ back)[::-1][1:], after[None, :]])
    return forward / forward.sum(1)[:, None], backward / backward.max(1)[:, None], m


def fit(blocks: DataFrame, model: Model, rounds: int = 100, least: float = 1e-2) -> tuple[Model, list[float]]:
    """The model after expectation-maximisation, until the log-likelihood grows by less than ``least``; and its course."""
    width, k = model.means.shape[1], len(model.start)
    course: list[float] = []
    names = ["start", "moves", "weight", "sums", "squares"]
    for _ in range(rounds):
        before, after, log, first = _borders(model, blocks, width)
        course.append(log)
        if len(course) > 1 and log - course[-2] < least:
            break

        def expected(block: int, x: np.ndarray, model: Model = model, before: dict = before, after: dict = after, first: int = first) -> dict[str, np.ndarray]:
            forward, backward, m = _passes(model, x, block == first, before[block], after[block])
            state = forward * backward
            state /= state.sum(1)[:, None]
            held = np.concatenate([before[block][None, :], forward[:-1]])
            both = held[:, :, None] * m * backward[:, None, :]
            both /= both.sum((1, 2))[:, None, None]
            return {
                "start": state[0] if block == first else np.zeros(k), "moves": both[int(block == first) :].sum(0),
                "weight": state.sum(0), "sums": state.T @ x, "squares": x.T @ x,
            }

        told = _each(blocks, expected, width, names)
        total = {n: sum(r[n] for r in told) for n in names}
        moves, weight = total["moves"].reshape(k, k), total["weight"]
        means = total["sums"].reshape(k, width) / np.maximum(weight, 1e-300)[:, None]
        spread = (total["squares"].reshape(width, width) - (means * weight[:, None]).T @ means) / weight.sum()
        held = moves.sum(1)
        moves = np.where(held[:, None] > 0, moves / np.maximum(held, 1e-300)[:, None], model.moves)
        means = np.where(weight[:, None] > 0, means, model.means)
        model = Model(total["start"], moves, means, spread + RIDGE * np.eye(width))
    return model, course


def _rows(blocks: DataFrame, fn: Callable[[int, np.ndarray], np.ndarray], width: int, names: list[str]) -> DataFrame:
    """at and the columns that ``fn`` makes, a row per step."""
    kind = blocks.schema["at"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = fn(batch.column(0)[i].as_py(), np.frombuffer(batch.column(2)[i].as_buffer(), "<f8").reshape(-1, width))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1).flatten(), *(pa.array(np.ascontiguousarray(made[:, k], float)) for k in range(len(names)))], names=["at", *names])

    return blocks.select("block", "at", "x").mapInArrow(run, f"at {kind}, " + ", ".join(f"{n} double" for n in names))


def probabilities(blocks: DataFrame, model: Model, smoothed: bool = True) -> DataFrame:
    """at, p0, p1, ...: each state's probability given all steps, or (filtered) those up to it."""
    width = model.means.shape[1]
    before, after, _, first = _borders(model, blocks, width)

    def tell(block: int, x: np.ndarray) -> np.ndarray:
        forward, backward, _ = _passes(model, x, block == first, before[block], after[block])
        state = forward * backward if smoothed else forward
        return state / state.sum(1)[:, None]

    return _rows(blocks, tell, width, [f"p{k}" for k in range(len(model.start))])


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(x), -1e300)


def likely_path(blocks: DataFrame, model: Model) -> DataFrame:
    """at and state of the most likely path; where several are equally likely, the lowest state of any at each step."""
    width, k = model.means.shape[1], len(model.start)
    first = blocks.agg(F.min("block")).first()[0]

    def steps(block: int, x: np.ndarray) -> np.ndarray:
        moves = np.broadcast_to(_log(model.moves), (len(x), k, k)).copy()
        if block == first:
            moves[0] = _log(np.eye(k))
        return moves + model.emissions(x)[:, None, :]

    told = _each(blocks, lambda block, x: {"m": best_sums(steps(block, x))[-1]}, width, ["m"])
    before, after, now = {}, {}, _log(model.start)
    for r in told:
        before[r["block"]] = now
        now = (now[:, None] + r["m"].reshape(k, k)).max(0)
        now = now - now.max()
    now = np.zeros(k)
    for r in reversed(told):
        after[r["block"]] = now
        now = (r["m"].reshape(k, k) + now[None, :]).max(1)
        now = now - now.max()

    def tell(block: int, x: np.ndarray) -> np.ndarray:
        m = steps(block, x)
        forward = (before[block][None, :, None] + best_sums(m)).max(1)
        back = best_sums(m[::-1].transpose(0, 2, 1))
        backward = np.concatenate([(after[block][None, :, None] + back).max(1)[::-1][1:], after[block][None, :]])
        return (forward + backward).argmax(1)[:, None]

    return _rows(blocks, tell, width, ["state"]).withColumn("state", F.col("state").cast("int"))


def recurrence(blocks: DataFrame, steps: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: float, width: int, name: str) -> DataFrame:
    """at and y, where y = a + b * (the y before), a and b as ``steps`` gives them for rows of ``x``; ``start`` stands before the first."""

    def affine(x: np.ndarray) -> np.ndarray:
        a, b = steps(x)
        m = np.zeros((len(x), 2, 2))
        m[:, 0, 0], m[:, 0, 1], m[:, 1, 1] = b, 0.0, 1.0
        m[:, 1, 0] = a
        return m

    def running(m: np.ndarray) -> np.ndarray:
        step = 1
        while step < len(m):
            m = np.concatenate([m[:step], m[:-step] @ m[step:]])
            step *= 2
        return m

    told = _each(blocks, lambda _, x: {"m": running(affine(x))[-1]}, width, ["m"])
    before, now = {}, np.array([start, 1.0])
    for r in told:
        before[r["block"]] = now
        now = now @ r["m"].reshape(2, 2)
    return _rows(blocks, lambda block, x: (before[block] @ running(affine(x)))[:, :1], width, [name])

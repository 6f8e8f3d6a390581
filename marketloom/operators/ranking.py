"""LambdaMART: gradient-boosted trees that learn to order the items of each group.

A group (a date's cross-section) is one row of a written table: its items, their features
as bin numbers, and their grades. The unit of a task is a group, as ranks are within
groups; groups are spread over all tasks and stay where they are from tree to tree.

For a tree, every task adds the last tree to its groups' scores and pulls each item up or
down: pairs of an item among the ``TOP`` of a group and any other, of different grades,
weigh as much as the discounted gain that changing them would move. So a group gives at
most TOP pairs an item. Scores and pulls are written, once a tree, beside the groups; the
step before is deleted. Splits are found on histograms: sums of pulls and of their
curvatures by node, feature and bin, which are added up in each task, and whose size
depends on the trees' depth and the features only; these sums, and nothing of the rows,
go to the driver.

Missing values have a bin of their own, below all others. Items without a grade are
scored and pull nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.steps import discard, written

TOP, BINS = 30, 32
#: Stands for no grade.
NONE = 255
#: Items whose pairs with the top are weighed at once; the arrays of so many stay in a core's cache.
CHUNK = 1000
#: A table of groups is dealt over at least so many tasks, so that few groups share one.
DEALT = 64


@dataclass
class Tree:
    """A complete tree by levels: node k has 2 k + 1 and 2 k + 2 below it; feature -1 sends all to the left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def place(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each item (row of bins) after some levels, counted from 0 within its level."""
        depth = int(np.log2(len(self.value)))
        at = np.zeros(len(x), np.int64)
        for level in range(depth if levels is None else levels):
            node = (1 << level) - 1 + at
            f = self.feature[node]
            at = 2 * at + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node]))
        return at


def scored(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += t.value[t.place(x)]
    return out


def gain(grade: np.ndarray) -> np.ndarray:
    return 2.0 ** grade.astype(float) - 1


def ndcg(score: np.ndarray, grade: np.ndarray, k: int) -> float:
    """Normalised discounted gain of the first ``k`` by score; equal scores in the order given."""
    weight = 1 / np.log2(np.arange(min(k, len(grade))) + 2)
    best = (np.sort(gain(grade))[::-1][:k] * weight).sum()
    return float((gain(grade)[np.argsort(-score, kind="stable")[:k]] * weight).sum() / best) if best > 0 else 0.0


def pulls(score: np.ndarray, grade: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """How strongly each item of a group is pulled up, and the curvature."""
    n = len(score)
    up, bend = np.zeros(n), np.zeros(n)
    known = np.flatnonzero(grade != NONE)
    if len(known) < 2:
        return up, bend
    s, g = score[known], gain(grade[known])
    order = np.argsort(-s, kind="stable")
    s, g = s[order], g[order]
    weight = 1 / np.log2(np.arange(len(s)) + 2)
    best = (np.sort(g)[::-1][:top] * weight[:top]).sum()
    if best <= 0:
        return up, bend
    first = min(top, len(s))
    a, b = np.zeros(len(s)), np.zeros(len(s))
    for i in range(0, len(s), CHUNK):
        some = slice(i, min(i + CHUNK, len(s)))
        # Each pair once: an item among the first with one ranked after it. Weights fall by rank, so other pairs lose nothing.
        lost = np.maximum(weight[:first, None] - weight[None, some], 0) / best
        ahead = g[:first, None] - g[None, some]
        wrong = s[:first, None] - s[None, some]
        wrong *= np.sign(ahead)
        np.exp(np.clip(wrong, -50, 50, out=wrong), out=wrong)
        wrong += 1
        np.reciprocal(wrong, out=wrong)
        lost *= wrong
        lost *= ahead
        a[:first] += lost.sum(1)
        a[some] -= lost.sum(0)
        curve = np.abs(lost, out=lost)
        curve *= np.subtract(1, wrong, out=wrong)
        b[:first] += curve.sum(1)
        b[some] += curve.sum(0)
    up[known[order]], bend[known[order]] = a, b
    return up, bend


def cuts_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Borders between the bins of each feature: its quantiles, to within a thousandth of the rows."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    told = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 1000).alias(c) for c in features]).first()
    return [sorted(set(told[c] or [])) for c in features]


def grouped(rows: DataFrame, group: str, item: str, features: list[str], grade: str, cuts: list[list[float]]) -> DataFrame:
    """A written row per group: items, x (bin numbers, a byte a feature) and y (grades, a byte an item)."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close(t: pa.Table) -> pa.RecordBatch:
            x = np.zeros((t.num_rows, len(features)), np.uint8)
            for k, c in enumerate(features):
                v = t[c].to_numpy().astype(float)
                x[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(cuts[k], v))
            y = t[grade].to_numpy().astype(float)
            y = np.where(np.isnan(y), NONE, y).astype(np.uint8)
            names = t[item].combine_chunks()
            return pa.RecordBatch.from_arrays(
                [t[group].slice(0, 1).combine_chunks(), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=[group, "items", "x", "y"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            codes = t[group].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            borders = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
            for i, j in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                part = t.slice(i, j - i)
                if held and held[0][group][0] != part[group][0]:
                    yield close(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield close(pa.concat_tables(held))

    spark = rows.sparkSession
    n = max(DEALT, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = rows.select(group, item, *features, grade).repartition(n, group).sortWithinPartitions(group, item)
    return written(at.mapInArrow(run, f"{group} {kinds[group]}, items array<{kinds[item]}>, x binary, y binary"))


def _pulled(state: DataFrame, last: Tree | None, width: int, top: int) -> DataFrame:
    """The written groups with scores that have the last tree added (``s``), pulls (``a``) and curvatures (``b``), eight bytes an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = np.frombuffer(batch["x"][k].as_buffer(), np.uint8).reshape(-1, width), np.frombuffer(batch["y"][k].as_buffer(), np.uint8)
                s = np.zeros(len(y)) if last is None else np.frombuffer(batch["s"][k].as_buffer()) + last.value[last.place(x)]
                own = [batch["x"].slice(k, 1), batch["y"].slice(k, 1)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([v.tobytes()], pa.binary()) for v in (s, *pulls(s, y, top))]], names=["x", "y", "s", "a", "b"])

    return written(state.mapInArrow(run, "x binary, y binary, s binary, a binary, b binary"))


def _histogram(pulled: DataFrame, growing: Tree, level: int, width: int, bins: int) -> np.ndarray:
    """Sums of pulls and curvatures by node of a level, feature and bin."""
    nodes = 1 << level
    size = nodes * width * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            for x, *both in zip(*batch.columns, strict=True):
                x, both = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width), [np.frombuffer(v.as_buffer()) for v in both]
                at = growing.place(x, level) * width * bins
                for f in range(width):
                    index = at + f * bins + x[:, f]
                    for k in (0, 1):
                        total[k] += np.bincount(index, both[k], size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["h"])

    told = pulled.select("x", "a", "b").mapInArrow(run, "h binary").collect()
    return sum((np.frombuffer(r["h"]) for r in told), np.zeros(2 * size)).reshape(2, nodes, width, bins)


def fit(groups: DataFrame, width: int, trees: int = 15, depth: int = 3, rate: float = 0.2, least: float = 1e-3, ridge: float = 1e-2, bins: int = BINS, top: int = TOP) -> list[Tree]:
    """Boosted trees over the ``grouped`` table; ``least`` is the least curvature of a leaf."""
    made: list[Tree] = []
    pulled = None
    for _ in range(trees):
        before, pulled = pulled, _pulled(groups.select("x", "y") if pulled is None else pulled.select("x", "y", "s"), made[-1] if made else None, width, top)
        if before is not None:
            discard(before)
        tree = Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth))
        for level in range(depth):
            pull, curve = _histogram(pulled, tree, level, width, bins)
            left, below = pull.cumsum(2), curve.cumsum(2)
            all_, whole = left[:, :1, -1:], below[:, :1, -1:]
            better = left**2 / (below + ridge) + (all_ - left) ** 2 / (whole - below + ridge) - all_**2 / (whole + ridge)
            better[(below < least) | (whole - below < least)] = 0
            for node in range(1 << level):
                f, c = np.unravel_index(better[node].argmax(), better[node].shape)
                splits = better[node, f, c] > 1e-12
                if splits:
                    tree.feature[(1 << level) - 1 + node], tree.cut[(1 << level) - 1 + node] = f, c
                if level == depth - 1:
                    one = left[node, f, c] if splits else all_[node, 0, 0]
                    own = below[node, f, c] if splits else whole[node, 0, 0]
                    tree.value[2 * node] = rate * one / (own + ridge)
                    tree.value[2 * node + 1] = rate * (all_[node, 0, 0] - one) / (whole[node, 0, 0] - own + ridge) if splits else 0.0
        made.append(tree)
        if not tree.value.any():
            break
    if pulled is not None:
        discard(pulled)
    return made


def scores(groups: DataFrame, group: str, item: str, trees: list[Tree], width: int) -> DataFrame:
    """group, item and score of all items."""
    schema = groups.schema
    kinds = schema[group].dataType.simpleString(), schema["items"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(x), k))), batch.column(1).slice(k, 1).flatten(), pa.array(scored(trees, x))], names=[group, item, "score"])

    return groups.select(group, "items", "x").mapInArrow(run, f"{group} {kinds[0]}, {item} {kinds[1]}, score double")

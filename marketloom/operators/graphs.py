"""Directed graphs in groups: strong components, and all short cycles.

Edges are rows ``grp, u, v`` (longs). A group is a graph of its own, such as a week's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.steps import discard, written

#: Edges of a group up to which one task finds its components; larger groups are spread.
LOCAL = 200_000
#: About as many of the longest paths are met in a task.
MEETING = 1_000_000
#: About as many of the longest paths, of both sides, are made at a time.
HALVES = 150_000_000
COMPONENTS = "grp long, node long, component long"


def components_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node of each one's strong component (depth-first, without recursion)."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    n = len(nodes)
    order = np.argsort(at[: len(u)], kind="stable")
    heads = at[len(u) :][order].tolist()
    first = np.searchsorted(at[: len(u)][order], np.arange(n + 1)).tolist()
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    number = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, first[root])]
        index[root] = low[root] = number
        number += 1
        stack.append(root)
        while work:
            x, k = work.pop()
            if k < first[x + 1]:
                work.append((x, k + 1))
                y = heads[k]
                if index[y] < 0:
                    index[y] = low[y] = number
                    number += 1
                    stack.append(y)
                    work.append((y, first[y]))
                elif comp[y] < 0:
                    low[x] = min(low[x], index[y])
                continue
            if low[x] == index[x]:
                cut = len(stack) - 1
                while stack[cut] != x:
                    cut -= 1
                least = min(stack[cut:])
                for y in stack[cut:]:
                    comp[y] = least
                del stack[cut:]
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[x])
    return nodes, nodes[np.array(comp, np.int64)] if n else nodes


def _in_tasks(edges: DataFrame) -> DataFrame:
    """The nodes of each group and their strong components, a group a call.

    Grouping is what guarantees that a group arrives whole: a repartition before a map over
    batches may be left out where rows already lie by group, and these be dealt anew at run time.
    """

    def run(group: pa.Table) -> pa.Table:
        node, component = components_of(group["u"].to_numpy(), group["v"].to_numpy())
        return pa.table({"grp": pa.array(np.full(len(node), group["grp"][0].as_py(), np.int64)), "node": node, "component": component})

    return edges.select("grp", "u", "v").groupBy("grp").applyInArrow(run, COMPONENTS)


def _trimmed_once(edges: DataFrame) -> DataFrame:
    """Edges whose start some edge enters and whose end some edge leaves."""
    heads, tails = edges.select("grp", F.col("v").alias("u")).distinct(), edges.select("grp", F.col("u").alias("v")).distinct()
    return edges.join(heads, ["grp", "u"], "left_semi").join(tails, ["grp", "v"], "left_semi").select("grp", "u", "v")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: what no edge enters, or leaves, goes, until nothing changes; a written step."""
    edges, before = written(edges), None
    while (n := edges.count()) and n != before:
        before = n
        for _ in range(3):
            edges = _trimmed_once(edges)
        edges = written(edges)
    return edges


def _settled(rows: DataFrame, step, measure) -> DataFrame:
    """``step`` again and again, until ``measure`` of its rows stays."""
    rows = written(rows)
    seen = rows.agg(measure).first()[0]
    while True:
        rows = written(step(rows))
        now = rows.agg(measure).first()[0]
        if now == seen:
            return rows
        seen = now


def _spread(edges: DataFrame) -> DataFrame:
    """Strong components of more than one node, by joins only.

    Edges are trimmed; every node takes the smallest node that reaches it as its colour;
    what reaches a colour's own node within the colour is that node's component. Components
    leave, and the rest goes on.
    """
    left, found = trimmed(edges), None
    while not left.isEmpty():
        start = left.select("grp", F.col("u").alias("node")).union(left.select("grp", "v")).distinct().withColumn("colour", F.col("node"))

        def coloured(c: DataFrame, left: DataFrame = left) -> DataFrame:
            sent = left.join(c.withColumnRenamed("node", "u"), ["grp", "u"]).select("grp", F.col("v").alias("node"), "colour")
            return c.unionByName(sent).groupBy("grp", "node").agg(F.min("colour").alias("colour"))

        colours = _settled(start, coloured, F.sum("colour"))
        inside = left.join(colours.withColumnsRenamed({"node": "u", "colour": "component"}), ["grp", "u"])
        inside = inside.join(colours.withColumnsRenamed({"node": "v", "colour": "component"}), ["grp", "v", "component"])
        inside = written(inside.select("grp", "component", "u", "v"))
        roots = colours.filter("node = colour").select("grp", "node", F.col("colour").alias("component"))

        def reached(r: DataFrame, inside: DataFrame = inside) -> DataFrame:
            back = inside.join(r.withColumnRenamed("node", "v"), ["grp", "component", "v"]).select("grp", F.col("u").alias("node"), "component")
            return r.unionByName(back).distinct()

        done = _settled(roots, reached, F.count(F.lit(1)))
        found = done if found is None else found.unionByName(done)
        rest = left
        for end in ("u", "v"):
            rest = rest.join(done.select("grp", F.col("node").alias(end)), ["grp", end], "left_anti")
        left = trimmed(rest)
    if found is None:
        return edges.sparkSession.createDataFrame([], COMPONENTS)
    big = found.groupBy("grp", "component").count().filter("count > 1").drop("count")
    return found.join(big, ["grp", "component"], "left_semi").select("grp", "node", "component")


def strong_components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """grp, node and component (its smallest node) of every node that lies on a cycle of two nodes or more.

    Groups of at most ``local`` edges are each done in a task; larger ones by joins over
    all of the cluster. Null ends and loops count for nothing, repeated edges once.
    """
    edges = written(edges.select("grp", "u", "v").filter("u <> v AND grp IS NOT NULL").distinct())
    sized = written(edges.groupBy("grp").count().filter(F.col("count") > local).select("grp"))
    large = edges.join(sized, "grp", "left_semi").select("grp", "u", "v")
    alone = _in_tasks(edges.join(sized, "grp", "left_anti"))
    together = alone.groupBy("grp", "component").count().filter("count > 1").drop("count")
    alone = alone.join(together, ["grp", "component"], "left_semi").select("grp", "node", "component")
    return alone if sized.isEmpty() else alone.unionByName(_spread(large))


def _narrowed(edges: DataFrame, local: int) -> DataFrame:
    """Edges that may lie on a cycle, a written step: within strong components in groups of at most ``local`` edges, trimmed in larger ones.

    A larger group is trimmed a fixed number of times: its components would take as many
    steps as its longest chain has nodes, and short cycles don't need them.
    """
    edges = written(edges.select("grp", "u", "v").filter("u <> v AND grp IS NOT NULL").distinct())
    sized = written(edges.groupBy("grp").count().filter(F.col("count") > local).select("grp"))
    alone = edges.join(sized, "grp", "left_anti").select("grp", "u", "v")
    inside = _in_tasks(alone)
    e = alone.join(inside.withColumnsRenamed({"node": "u"}), ["grp", "u"]).join(inside.withColumnsRenamed({"node": "v"}), ["grp", "v", "component"]).select("grp", "u", "v")
    if not sized.isEmpty():
        e = e.unionByName(_trimmed_once(_trimmed_once(edges.join(sized, "grp", "left_semi").select("grp", "u", "v"))))
    return written(e)


def _walks(e: DataFrame, near: str, far: str, most: int) -> float:
    """How many walks of ``most`` edges there are, by counts and without walking them."""
    ends = e.groupBy("grp", near).agg(F.count(F.lit(1)).cast("double").alias("n"))
    for _ in range(most - 1):
        ends = e.join(ends.withColumnRenamed(near, far), ["grp", far]).groupBy("grp", near).agg(F.sum("n").alias("n"))
    return ends.agg(F.sum("n")).first()[0] or 0.0


def cycles(edges: DataFrame, longest: int, shortest: int = 3, local: int = LOCAL, halves: int = HALVES) -> DataFrame:
    """All simple cycles of ``shortest`` to ``longest`` nodes: grp and path (its nodes in order, the smallest first).

    A cycle is met in its middle: a path of half its edges forward from its smallest node,
    and one of the other half backward, end at the same node and share no other. So paths
    have half a cycle's length, and each cycle is found once. No node or edge is left out.
    A path's nodes are columns; the longest paths, which are most of all, go into the
    meeting's shuffle and are never written. Where there are more than about ``halves`` of
    them, smallest nodes take turns: what a round finds is written, and its paths and shuffles go.
    """
    e = _narrowed(edges, local)
    half = (longest + 1) // 2
    # One in half + 1 begins with its smallest node, more or less.
    expected = (_walks(e, "u", "v", half) + _walks(e, "v", "u", longest // 2)) / (half + 1)
    if expected <= halves:
        return _met(e, F.lit(True), longest, shortest)[0]
    parts = math.ceil(min(expected / halves, e.select("grp", "u").distinct().count()))
    found, begin, take = None, 0, 1
    while begin < parts:
        turn = F.pmod(F.xxhash64("grp", "first"), F.lit(parts)).between(begin, begin + take - 1)
        met, steps, made = _met(e, turn, longest, shortest)
        met = written(met)
        discard(*steps)
        found = met if found is None else found.unionByName(met)
        begin += take
        take = max(1, int(take * halves / max(1.0, made)))
    return found


def _met(e: DataFrame, turn: Column, longest: int, shortest: int) -> tuple[DataFrame, list[DataFrame], float]:
    """The cycles whose smallest node has its turn, the written steps that they are read from, and about how many of the longest paths are made."""
    half = (longest + 1) // 2
    tasks = 4 * e.sparkSession.sparkContext.defaultParallelism
    steps: list[DataFrame] = []

    def halves(near: str, far: str, most: int) -> list[DataFrame]:
        """Paths (n1, n2, ...) of 1, 2, ... edges away from their smallest node; ``near`` and ``far`` are the ends of an edge as it is walked."""
        ways = [e.filter(F.col(far) > F.col(near)).select("grp", F.col(near).alias("first"), F.col(far).alias("n1")).filter(turn)]
        for k in range(1, most):
            at, on = f"n{k}", f"n{k + 1}"
            # Few edges make many paths: left to the planner, they would all be made in a task or two.
            step = ways[-1].repartition(tasks, "grp", at).join(e.select("grp", F.col(near).alias(at), F.col(far).alias(on)), ["grp", at]).filter(F.col(on) > F.col("first"))
            for i in range(1, k):
                step = step.filter(F.col(on) != F.col(f"n{i}"))
            step = step.select("grp", "first", *[f"n{i}" for i in range(1, k + 2)])
            if k + 1 < most:
                step = written(step)
                steps.append(step)
            ways.append(step)
        return ways

    def longest_of(ways: list[DataFrame]) -> float:
        """As many more paths than one edge shorter as these are more than those before them."""
        return ways[-2].count() ** 2 / max(1, ways[-3].count()) if len(ways) > 2 else 0.0

    forward, backward = halves("u", "v", half), halves("v", "u", longest // 2)
    most, found = longest_of(forward), None
    for k in range(1, half + 1):
        # Those of k edges meet those as long, and those of one edge less, at one time.
        others = None
        for n in (2 * k - 1, 2 * k):
            if max(shortest, 2) <= n <= longest:
                size = n - k
                inner = [(F.col(f"n{i}") if i < size else F.lit(None).cast("long")).alias(f"o{i}") for i in range(1, k)]
                other = backward[size - 1].select("grp", "first", F.col(f"n{size}").alias(f"n{k}"), *inner)
                others = other if others is None else others.unionByName(other)
        if others is None:
            continue
        # Where these are sorted, the key that differs most comes first.
        there, keys = forward[k - 1], [f"n{k}", "first", "grp"]
        if k == half > 2:
            # So few paths meet in a task that one side of them can be hashed, and no side need be sorted.
            there, others = there.repartition(max(tasks, int(most) // MEETING), *keys), others.hint("shuffle_hash")
        met = there.join(others, keys)
        for i in range(1, k):
            for j in range(1, k):
                met = met.filter(~F.col(f"n{i}").eqNullSafe(F.col(f"o{j}")))
        path = F.array_compact(F.array("first", *[f"n{i}" for i in range(1, k + 1)], *[f"o{j}" for j in range(k - 1, 0, -1)]))
        met = met.select("grp", path.alias("path"))
        found = met if found is None else found.unionByName(met)
    return found, steps, most + longest_of(backward)

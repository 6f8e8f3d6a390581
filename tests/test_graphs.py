"""Strong components and cycles against closures and depth-first search."""

from __future__ import annotations

import sys

import numpy as np
import pytest

from marketloom.operators import graphs

EDGES = "grp long, u long, v long"


def random_edges(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for grp, (n, m) in enumerate([(5, 8), (9, 14), (12, 40), (40, 50), (3, 0), (6, 6)]):
        rows += [(grp, int(a) * 3, int(b) * 3) for a, b in rng.integers(0, n, (m, 2))]
    # A ring, a chain, and a pair.
    rows += [(10, k, (k + 1) % 9) for k in range(9)] + [(11, k, k + 1) for k in range(7)] + [(12, 5, 2), (12, 2, 5), (12, 5, 2), (12, 7, 7)]
    return rows


def closures(rows):
    """Components of two nodes or more, by who reaches whom."""
    out = set()
    for grp in {r[0] for r in rows}:
        edges = {(u, v) for g, u, v in rows if g == grp and u != v}
        far = set(edges)
        while True:
            more = {(a, d) for a, b in far for c, d in edges if b == c} - far
            if not more:
                break
            far |= more
        for a in {x for e in edges for x in e}:
            own = [b for b in {x for e in edges for x in e} if (a, b) in far and (b, a) in far]
            if len(own) > 1:
                out.add((grp, a, min(own)))
    return out


def walked(rows, longest, shortest):
    out = set()
    for grp in {r[0] for r in rows}:
        after = {}
        for g, u, v in rows:
            if g == grp and u != v:
                after.setdefault(u, set()).add(v)

        def on(path, after=after, grp=grp):
            for v in after.get(path[-1], ()):
                if v == path[0] and len(path) >= shortest:
                    out.add((grp, tuple(path)))
                elif v > path[0] and v not in path and len(path) < longest:
                    on([*path, v])

        for first in after:
            on([first])
    return out


@pytest.mark.parametrize("local", [0, 20, graphs.LOCAL])
def test_components_in_tasks_and_by_joins(spark, local):
    rows = random_edges(local)
    got = graphs.strong_components(spark.createDataFrame(rows, EDGES), local).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == closures(rows)


@pytest.mark.parametrize("longest, shortest", [(8, 3), (5, 2), (2, 2)])
def test_cycles_are_all_found_once(spark, longest, shortest):
    rows = [r for r in random_edges(7) if r[0] != 2] + [(2, a, b) for a in range(5) for b in range(5)]
    got = [(r["grp"], tuple(r["path"])) for r in graphs.cycles(spark.createDataFrame(rows, EDGES), longest, shortest).collect()]
    want = walked(rows, longest, shortest)
    assert len(got) == len(set(got)) and set(got) == want
    assert want


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert graphs.strong_components(none).collect() == [] and graphs.cycles(none, 4).collect() == []
    assert graphs.strong_components(spark.createDataFrame([(1, 2, None), (None, 1, 2), (1, 3, 3)], EDGES)).collect() == []


def test_deep_chains_need_no_recursion():
    n = 50_000
    nodes, component = graphs.components_of(np.arange(n), np.r_[np.arange(1, n), n // 2])
    assert (component[: n // 2] == nodes[: n // 2]).all() and (component[n // 2 :] == n // 2).all()


def test_groups_stay_whole_when_joins_change_at_run_time(spark):
    """Joins planned as sorted ones and run as broadcasts, as on large tables, must not part a group's edges."""
    told = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for n, v in told.items():
            spark.conf.set(n, v)
        ids = spark.range(0, 20_000, 1, 8)
        rings = ids.selectExpr("id % 40 AS grp", "id div 40 AS u", "(id div 40 + 1) % 500 AS v")
        got = graphs.strong_components(rings).selectExpr("count(*)", "count(DISTINCT grp, node)", "max(component)").first()
        assert tuple(got) == (20_000, 20_000, 0)
    finally:
        for n in told:
            spark.conf.unset(n)


def test_reach_and_depths_equal_walks_with_few_rows_for_many_owners(spark):
    from marketloom.plans import catalog

    relations = sys.modules[catalog.QUERIES["ownership_depth"].__module__.replace("catalog", "relations")]

    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(-40, 100, (420, 2))} | {(k, k + 1) for k in range(1000, 1012)} | {(5, 5)}
    frame = spark.createDataFrame(sorted(edges), "owner long, owned long")
    front, first, longest = set(edges), {}, {}
    for k in range(1, 9):
        for a, b in front:
            first.setdefault((a, b), k)
            longest[a] = k
        front = {(a, d) for a, b in front for c, d in edges if b == c}
    found = relations.reach(frame)
    got = relations.pairs(found).collect()
    assert {tuple(r) for r in got} == {(a, b, k) for (a, b), k in first.items()} and len(got) == len(first)
    assert {tuple(r) for r in relations.depths(frame).collect()} == set(longest.items())
    # Owners of one entity lie in words, so there are far fewer rows than pairs.
    assert found.count() * 3 < len(first)


def test_cycles_found_in_rounds_leave_no_paths_behind(spark, monkeypatch):
    """Where half paths are many, their smallest nodes take turns; of a turn only what it found stays."""
    from pathlib import Path

    from marketloom.operators.steps import folder

    turns, plain = [], graphs._met

    def counted(*told):
        turns.append(told)
        return plain(*told)

    monkeypatch.setattr(graphs, "_met", counted)
    rows = [r for r in random_edges(7) if r[0] != 3] + [(3, 4 * k, 4 * ((k + j) % 30)) for k in range(30) for j in (1, 2)]
    steps, shuffles = Path(folder(spark)), Path(spark.conf.get("spark.local.dir"))
    before = set(steps.iterdir())
    frame = spark.createDataFrame(rows, EDGES)
    got = graphs.cycles(frame, 6, 2, halves=120)
    # The edges three times, as they are narrowed, and what each turn found.
    assert len(turns) > 2 and len(set(steps.iterdir()) - before) <= 3 + len(turns)
    made = [f for f in shuffles.rglob("shuffle_*.data")]
    got = [(r["grp"], tuple(r["path"])) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows, 6, 2)
    # Its shuffles went before: reading what was found needs none.
    assert len([f for f in shuffles.rglob("shuffle_*.data") if f not in made]) == 0


def test_what_owners_control_is_counted_in_rounds_of_wide_rows(spark):
    from marketloom.plans import catalog

    relations = sys.modules[catalog.QUERIES["ownership_depth"].__module__.replace("catalog", "relations")]
    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)) for a, b in rng.integers(-300, 4000, (900, 2)) // 3 * 3} | {(k, k + 3) for k in range(0, 2400, 3)}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    far = {}
    for a in after:
        front = far[a] = set(after[a])
        for _ in range(4):
            front = {c for b in front for c in after.get(b, ())} - far[a]
            far[a] = far[a] | front
    frame = spark.createDataFrame(sorted(edges), "owner long, owned long")
    rounds = list(relations.reaches(frame, 5, passed=1500))
    rows = [sum(step.count() for step in found) for found in rounds]
    assert len(rounds) > 2 and sum(rows) * 3 < 5 * sum(map(len, far.values()))
    got = relations.controlled(frame, 5, passed=1500).collect()
    assert {tuple(r) for r in got} == {(a, len(x - {a}), a in x) for a, x in far.items()} and len(got) == len(far)
    none = frame.filter("owner IS NULL")
    assert relations.controlled(none).collect() == [] and relations.pairs(relations.reach(none)).collect() == []


def test_a_step_reaches_a_thousand_entities_in_a_row(spark):
    """Pairs of owner and owned grow with the square of the entities; a row holds all that one owner reaches in a step."""
    from marketloom.plans import catalog

    relations = sys.modules[catalog.QUERIES["transitive_ownership"].__module__.replace("catalog", "relations")]
    n = 700
    u, v = np.random.default_rng(11).integers(0, n, (2, 6 * n))
    steps, front = np.zeros((n, n), int), np.eye(n, dtype=bool)
    edge = np.zeros((n, n), int)
    edge[u, v] = 1
    for k in range(1, 9):
        front = (front @ edge > 0) & (steps == 0)
        steps[front] = k
    found = relations.reach(spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "owner long, owned long"))
    assert found.count() <= n * steps.max() and (steps > 0).sum() > 100 * found.count()
    got = np.array(relations.pairs(found).collect())
    again = np.zeros((n, n), int)
    again[got[:, 0], got[:, 1]] = got[:, 2]
    assert (again == steps).all() and len(got) == (steps > 0).sum()


def test_shuffles_of_a_written_step_leave_no_files(spark):
    from pathlib import Path

    from marketloom.operators import steps

    def files():
        return {f for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    before = files()
    out = steps.written(spark.range(0, 100_000, 1, 4).selectExpr("id % 7 AS k").groupBy("k").count().repartition(3, "count"))
    left = files() - before
    assert not left and out.count() == 7


def test_short_cycles_of_a_large_group_need_few_steps(spark, monkeypatch):
    """A long ring in a group that is spread: steps follow the cycles' length, not the ring's."""
    steps, plain = [], graphs.written

    def counted(df):
        steps.append(df)
        assert len(steps) <= 20
        return plain(df)

    monkeypatch.setattr(graphs, "written", counted)
    rows = [(0, k, (k + 1) % 300) for k in range(300)] + [(0, 5, 2), (0, 9, 8), (0, 40, 33), (0, 60, 52), (0, 900, 901)]
    got = {tuple(r["path"]) for r in graphs.cycles(spark.createDataFrame(rows, EDGES), 8, 2, local=0).collect()}
    assert got == {(2, 3, 4, 5), (8, 9), tuple(range(33, 41))}

"""Neighbour search and embedding near-dedup against all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import ann, neardup, queries

VECTORS = "vec_id long, embedding array<float>, label int, x int, rep int, n int, id int, k int"


def vectors(spark, folder):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ok = [r for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    return rows, ok


def nearest(ok, asked, k):
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok], float)
    out = {}
    for i in np.flatnonzero([asked(int(v)) for v in ids]):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_search_query_recall_and_scores(spark, medium):
    _, ok = vectors(spark, medium)
    want = nearest(ok, lambda v: v % 20 == 0, 20)
    x = {r[0]: np.array(r[1], float) for r in ok}
    got = {}
    for r in queries.op4_approximate_neighbours(spark, medium).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1)) and q not in [r[1] for r in rows]
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in rows)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r[1] for r in rows} & {v for v, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_over_several_shards(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 12)) * rng.uniform(0.2, 3, (1500, 1))
    ok = [(i, v.tolist(), 0) for i, v in enumerate(np.float32(x))]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in ok], VECTORS)
    good = frame.select(F.col("vec_id").alias("rep"), F.col("embedding").cast("array<double>").alias("x"))
    index, sizes = ann.build_index(good, 11, 0.95, shard_rows=300)
    assert index.count() == 5 and index.agg(F.min("recall")).first()[0] >= 0.9
    found = ann.search_index(index, sizes, good.filter("rep % 100 = 0").withColumnRenamed("rep", "query_id"), 11).collect()
    want = nearest(ok, lambda v: v % 100 == 0, 10)
    hits = sum(len({r["rep"] for r in found if r["query_id"] == q} & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def odd_vectors(spark):
    one, other = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(i, one, 1) for i in range(40)] + [(40, None, 1), (41, [0.0, 0.0, 0.0], 1), (42, [1.0, None, 0.0], 1), (60, [float("nan"), 1.0, 0.0], 1), (80, [float("inf"), 1.0, 0.0], 1), (43, other, 1), (44, one, 2), (45, one, None), (None, one, 1)]
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS)


def test_search_edge_rows(spark):
    frame = odd_vectors(spark)
    rows = ann.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    assert {r["query_id"] for r in rows} == {0, 20}
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 20] == list(range(20))
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0, 20).collect() == []
    few = ann.nearest(frame.filter("vec_id in (0, 43, 44)"), F.col("vec_id") == 0, 20).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few)] == [(1, 44), (2, 43)]
    # Repeated rows count once; of an id with two vectors the least counts.
    twice = frame.unionByName(frame).unionByName(frame.filter("vec_id = 43").withColumn("vec_id", F.lit(0).cast("long")))
    again = ann.nearest(twice.filter("vec_id in (0, 43, 44)"), F.col("vec_id") == 44, 20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(again)] == [(1, 0, 0.0), (2, 43, 0.0)]


def test_search_of_uneven_lengths(spark):
    rng = np.random.default_rng(2)
    # Lengths over several orders of magnitude: few long vectors are nearest to nearly all.
    x = rng.standard_normal((3000, 24)) * np.exp(rng.standard_normal((3000, 1)) * 1.5)
    ok = [(i, v.tolist(), 0) for i, v in enumerate(np.float32(x))]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in ok], VECTORS)
    want = nearest(ok, lambda v: v % 20 == 0, 20)
    found = ann.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    hits = sum(len({r["vec_id"] for r in found if r["query_id"] == q} & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values())) and {r["recall"] >= 0.9 for r in found} == {True}


def linked(rows, ok, least):
    ids, label = np.array([r[0] for r in ok]), np.array([-1 if r[2] is None else r[2] for r in ok])
    x = np.array([r[1] for r in ok], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    link = (x @ x.T >= least) & (label[:, None] == label) & (label >= 0)[:, None]
    np.fill_diagonal(link, False)
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(ids)).min(1, initial=len(ids)))
        if (new == root).all():
            break
        root = new
    order = {i: (int(n), int(min(ids[root == r]))) for i, n, r in zip(ids.tolist(), link.sum(1), root, strict=True)}
    return {(r[0], *order.get(r[0], (0, r[0])), order.get(r[0], (0, r[0]))[1] == r[0]) for r in rows}


def test_near_dedup_query(spark, small):
    rows, ok = vectors(spark, small)
    got = queries.op7_embedding_near_dedup(spark, small).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == linked(rows, ok, 0.93)


def test_near_dedup_of_dense_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    # Groups larger than the longest list, whose members link with some of the others only.
    x = np.concatenate([centres[k] + rng.standard_normal((150, 16)) * s for k, s in enumerate((0.05, 0.1, 0.16, 0.2, 0.25, 0.3))])
    rows = [(i, np.float32(v).tolist(), i % 2) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS)
    got = {r["vec_id"]: r for r in neardup.near_duplicate_vectors(frame, 0.93).collect()}
    want = {w[0]: w for w in linked(rows, rows, 0.93)}
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(w[1] for w in want.values())
    assert all(r["n_links"] <= want[i][1] for i, r in got.items())
    assert np.mean([r["component_id"] == want[i][2] for i, r in got.items()]) >= 0.99


def test_near_dedup_counts_cores_without_comparing(spark, monkeypatch):
    rng = np.random.default_rng(12)
    # Tight groups with rims of several distances, and copies; blocks so small that all kinds of pairs of blocks occur.
    centres = rng.standard_normal((4, 24))
    x = np.concatenate([c + rng.standard_normal((60, 24)) * s for c in centres for s in (0.03, 0.15)] + [np.repeat(centres, 3, 0)])
    rows = [(i, np.float32(v).tolist(), i % 2) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    compared = []
    whole = neardup._counted
    monkeypatch.setattr(neardup, "_counted", lambda members, threshold: compared.append(members) or whole(members, threshold))
    assert {tuple(r) for r in neardup.near_duplicate_vectors(frame, 0.93).collect()} == linked(rows, rows, 0.93)
    # No pair of blocks holds core members only.
    assert compared[0].filter("core").count() > 0 and compared[0].filter("one >= ceil(size / 7)").count() == 0


def test_near_dedup_edge_rows(spark):
    frame = odd_vectors(spark)
    got = sorted(map(tuple, neardup.near_duplicate_vectors(frame, 0.93).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got[:40] == [(i, 39, 0, i == 0) for i in range(40)]
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in got[40:] if r[0] is not None)
    assert len(got) == frame.count() and got[-1][0] is None
    assert neardup.near_duplicate_vectors(frame.limit(0), 0.93).collect() == []


def listed(spark, rows):
    """Nodes as near-dedup holds them: (id, vector, near, sim) of one label."""
    x = neardup.codes(np.array([r[1] for r in rows], float))
    held = [(r[0], 1, bytearray(c.tobytes()), neardup.SHORTEST, r[2], r[3], []) for r, c in zip(rows, x, strict=True)]
    return spark.createDataFrame([h[: len(neardup.NODES.split(", "))] for h in held], neardup.NODES)


def test_near_dedup_keeps_the_only_link_of_two_saturated_groups(spark):
    # Lists are full of a node's own group; the two links to the other group are the farthest.
    nodes = listed(spark, [(g * 1000 + i, [1.0, 0.0], [], []) for g in (0, 1) for i in range(100)])
    offers = [(g * 1000 + i, [g * 1000 + j for j in range(100) if j != i], [0.99] * 99) for g in (0, 1) for i in range(100)]
    offers = spark.createDataFrame([*offers, (5, [1007], [0.94]), (1007, [5], [0.94])], neardup.OFFERS)
    got = neardup._take(neardup._take(nodes, offers, 0.91), offers.limit(0), 0.91).collect()
    assert len(got) == 200 and max(len(r["near"]) for r in got) == neardup.LONGEST
    joined = {(r["id"], v) for r in got for v in [*r["near"], *(r.asDict().get("joins") or [])]}
    assert (5, 1007) in joined or (1007, 5) in joined


def test_near_dedup_meets_all_neighbours_of_a_hub(spark):
    rng = np.random.default_rng(8)
    # The hub is in the lists of 200 nodes; 100 pairs of them are close, far from the hub.
    x = np.repeat(rng.standard_normal((100, 32)), 2, 0) + rng.standard_normal((200, 32)) * 0.05
    rows = [(0, np.ones(32), [], [])] + [(i + 1, v, [0], [0.001 * (i // 2)]) for i, v in enumerate(x)]
    offers = {(r["id"], v) for r in neardup._meet(listed(spark, rows)).collect() for v in r["near"]}
    assert all((i, i + 1) in offers for i in range(1, 200, 2))


def test_near_dedup_pairs_meet_at_the_start(spark):
    rng = np.random.default_rng(9)
    # 2000 isolated pairs at the threshold; windows and tables must bring nearly all of them together.
    a = rng.standard_normal((2000, 64))
    a /= np.sqrt((a * a).sum(1))[:, None]
    b = rng.standard_normal((2000, 64))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.sqrt((b * b).sum(1))[:, None]
    x = np.stack([a, 0.935 * a + np.sqrt(1 - 0.935**2) * b], 1).reshape(-1, 64)
    nodes = listed(spark, [(i, v, [], []) for i, v in enumerate(x)]).repartition(8)
    bits = 12
    tables = neardup.tables_for(bits, 0.93, 0.999)
    assert tables > neardup.tables_for(6, 0.93, 0.999) and 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables >= 0.999
    met = {(r["id"], v) for r in neardup._start(nodes, tables, 1, bits, 0.91).collect() for v in r["near"]}
    assert np.mean([(i, i + 1) in met for i in range(0, 4000, 2)]) >= 0.995


def test_near_dedup_compares_all_pairs_when_the_search_fails(spark, monkeypatch):
    # A search that finds nothing must not be returned.
    monkeypatch.setattr(neardup, "_start", lambda nodes, *_: nodes.select("id", "near", "sim").limit(0))
    rng = np.random.default_rng(10)
    x = np.repeat(rng.standard_normal((40, 16)), 3, 0) + rng.standard_normal((120, 16)) * 0.2
    rows = [(i, np.float32(v).tolist(), i % 2) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS)
    want = linked(rows, rows, 0.93)
    assert sum(w[1] for w in want) > 20
    assert {tuple(r) for r in neardup.near_duplicate_vectors(frame, 0.93, attempts=1).collect()} == want


def test_search_beside_one_long_vector(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1200, 12))
    x[7] *= 1e5
    ok = [(i, v.tolist(), 0) for i, v in enumerate(np.float32(x))]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in ok], VECTORS)
    want = nearest(ok, lambda v: v % 40 == 0, 10)
    found = ann.nearest(frame, F.col("vec_id") % 40 == 0, 10).collect()
    hits = sum(len({r["vec_id"] for r in found if r["query_id"] == q} & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def several_lengths(seed):
    """Vectors of three lengths, near copies among them, and equal beginnings across lengths."""
    rng = np.random.default_rng(seed)
    rows = []
    for d, n in ((8, 400), (5, 60), (3, 3)):
        x = np.repeat(rng.standard_normal((-(-n // 3), d)), 3, 0)[:n] + rng.standard_normal((n, d)) * 0.15
        rows += [np.float32(v).tolist() for v in x]
    return [(i, v, i % 2) for i, v in enumerate(rows)] + [(463, [1.0, 2.0], 1), (464, [2.0, 4.0], 1), (465, [], 1)]


def test_near_dedup_of_several_lengths(spark, monkeypatch):
    rows = several_lengths(21)
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS)
    want = set()
    for d in (8, 5, 3, 2):
        own = [r for r in rows if len(r[1]) == d]
        want |= linked(own, own, 0.93)
    want.add((465, 0, 465, True))
    assert (463, 1, 463, True) in want
    assert {tuple(r) for r in neardup.near_duplicate_vectors(frame, 0.93).collect()} == want
    # A second length that has many vectors is searched as the commonest is.
    monkeypatch.setattr(neardup, "FEW", 30)
    assert {tuple(r) for r in neardup.near_duplicate_vectors(frame, 0.93).collect()} == want


def test_search_of_several_lengths(spark):
    rows = several_lengths(22)
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], VECTORS)
    found = ann.nearest(frame, F.col("vec_id") % 8 == 0, 10).collect()
    for d in (8, 5, 3, 2):
        own = [r for r in rows if len(r[1]) == d]
        want = nearest(own, lambda v: v % 8 == 0, 10)
        got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
        assert all({len(got[q]), len(w)} == {min(10, len(own) - 1)} for q, w in want.items())
        assert sum(len(set(got[q]) & {v for v, _ in w}) for q, w in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_search_is_split_over_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "BATCH", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(23)
    ok = [(i, v.tolist(), 0) for i, v in enumerate(np.float32(rng.standard_normal((900, 8))))]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in ok], VECTORS)
    want = nearest(ok, lambda v: v % 2 == 0, 5)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 2 == 0, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.95 * 5 * len(want)

"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Vectors are dealt over shards by hash. In each shard one more component puts all
of them on a sphere, so that the largest inner product is the smallest distance.
The shard's directed graph is built in two passes over batches of nodes: a greedy
beam search from the medoid proposes neighbours, robust pruning (with a relaxed
distance in the second pass) keeps diverse ones, and edges are made mutual. The
shard then measures its recall on a bounded sample of its own vectors against
brute force, and widens its search beam until the target is met. A shard that misses
it at the widest beam is searched by brute force, in double precision.

Queries are sent to every shard of their vectors' length, each of which is read once
(where shards are fewer than cores, once for each of a few blocks of queries); each
gives its best, and the best of all shards remain. Equal vectors are one node of the graph; the smallest ids of each
are put back in at the end.

Vectors that are null, zero or hold null or non-finite components take no part; those
of another length than a query's are no neighbours of it. Ties go to the smaller id. Repeated
rows count once; of an id with several vectors the least counts. An empty table gives
no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.groups import borders, runs
from marketloom.llm.storage import staged
from marketloom.llm.vectors import matrix, usable

SHARD_ROWS = 32_768
DEGREE, ROOM, BEAM = 32, 48, 64
WIDEST = 512
#: Stands for the beam of a shard that is searched by brute force.
EXACT = 0
BATCH = 256
#: Vectors of a shard whose neighbours are compared with brute force.
PROBES = 48
QUERY_BLOCK = 16_384


class Graph:
    """A directed graph over unit-sphere points, with batched beam search."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, start: int = 0):
        self.x, self.start = np.ascontiguousarray(x, np.float32), start
        self.edges = np.full((len(x), ROOM), -1, np.int32) if edges is None else edges

    def search(self, q: np.ndarray, beam: int, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query, nearest first: nodes (-1 where fewer) and distances."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)
        seen[:, -1] = True  # stands for no node
        node = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        node[:, 0], done[:, 0] = self.start, False
        far[:, 0] = ((q - self.x[self.start]) ** 2).sum(1)
        seen[:, self.start] = True
        while not done.all():
            # The first few of the beam that aren't expanded yet.
            order = np.argsort(done, axis=1, kind="stable")[:, :ahead]
            open_ = ~np.take_along_axis(done, order, 1)
            np.put_along_axis(done, order, True, 1)
            at = np.where(open_, np.take_along_axis(node, order, 1), -1)
            near = np.where((at >= 0)[:, :, None], self.edges[at], -1).reshape(n, -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            width = max(int((near >= 0).sum(1).max()), 1)
            near = -np.partition(-near, min(width, near.shape[1]) - 1, axis=1)[:, :width]
            seen[rows, near] = True
            d = np.where(near >= 0, 2.0 - 2.0 * np.matmul(self.x[near], q[:, :, None])[:, :, 0], np.inf).astype(np.float32)
            node, far, done = (np.concatenate(p, 1) for p in ((node, near), (far, d), (done, near < 0)))
            best = np.argsort(far, axis=1, kind="stable")[:, :beam]
            node, far, done = (np.take_along_axis(p, best, 1) for p in (node, far, done))
        return node, far

    def prune(self, of: np.ndarray, near: np.ndarray, far: np.ndarray, relax: float, degree: int = DEGREE) -> np.ndarray:
        """Robust pruning: take the nearest, drop those relaxed-nearer to it than to the node, repeat."""
        out = np.full((len(of), ROOM), -1, np.int32)
        far = np.where((near < 0) | (near == of[:, None]), np.inf, far)
        points = self.x[near]
        for k in range(degree):
            best = far.argmin(1)
            value = np.take_along_axis(far, best[:, None], 1)[:, 0]
            if not np.isfinite(value).any():
                break
            chosen = near[np.arange(len(of)), best]
            out[:, k] = np.where(np.isfinite(value), chosen, -1)
            between = 2.0 - 2.0 * np.matmul(points, self.x[chosen][:, :, None])[:, :, 0]
            far = np.where(relax * between <= far, np.inf, far)
            far[np.arange(len(of)), best] = np.inf
        return out

    def distances(self, of: np.ndarray, near: np.ndarray) -> np.ndarray:
        return 2.0 - 2.0 * np.matmul(self.x[near], self.x[of][:, :, None])[:, :, 0]

    def add_reverse(self, of: np.ndarray, relax: float) -> None:
        """Makes the edges of nodes ``of`` mutual; a node without room is pruned."""
        source, slot = np.nonzero(self.edges[of] >= 0)
        target, source = self.edges[of][source, slot], of[source]
        known = (self.edges[target] == source[:, None]).any(1)
        target, source = target[~known], source[~known]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        free = (self.edges[target] >= 0).sum(1) + place
        fits = free < ROOM
        self.edges[target[fits], free[fits]] = source[fits]
        rest = np.unique(target[~fits])
        for i in range(0, len(rest), 1024):
            t = rest[i : i + 1024]
            lost = np.isin(target, t) & ~fits
            extra = np.full((len(t), int(np.bincount(np.searchsorted(t, target[lost])).max())), -1, np.int32)
            row = np.searchsorted(t, target[lost])
            extra[row, np.arange(len(row)) - np.searchsorted(row, row)] = source[lost]
            near = np.concatenate([self.edges[t], extra], 1)
            self.edges[t] = self.prune(t, near, self.distances(t, near), relax)

    def build(self, seed: int = 3) -> None:
        n, rng = len(self.x), np.random.default_rng(seed)
        middle = self.x.mean(0)
        self.start = int(((self.x - middle) ** 2).sum(1).argmin())
        if n == 1:
            return
        self.edges[:, : min(8, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(8, n - 1)))) % n
        for relax in (1.0, 1.2):
            order = rng.permutation(n)
            for i in range(0, n, BATCH):
                of = order[i : i + BATCH]
                near, far = self.search(self.x[of], BEAM)
                old = self.edges[of]
                # A neighbour that the search found as well must not count twice.
                twice = (old[:, :, None] == near[:, None, :]).any(2)
                old = np.where(twice, -1, old)
                near, far = np.concatenate([near, old], 1), np.concatenate([far, self.distances(of, old)], 1)
                self.edges[of] = self.prune(of, near, far, relax)
                self.add_reverse(of, relax)


def on_sphere(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest length, with the component that fills up to 1."""
    norm = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1) / np.sqrt(norm.max())


def queries_on_sphere(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)


def fit_beam(graph: Graph, x: np.ndarray, k: int, target: float, seed: int = 5) -> tuple[int, float]:
    """The narrowest beam whose recall over sampled vectors, against brute force, meets the target; EXACT where none does."""
    some = np.random.default_rng(seed).permutation(len(x))[:PROBES]
    k = min(k, len(x))
    true = np.argpartition(-(x[some] @ x.T), k - 1, axis=1)[:, :k]
    beam = BEAM
    while True:
        found, _ = graph.search(queries_on_sphere(x[some]), max(beam, k))
        recall = float((true[:, :, None] == found[:, None, :]).any(2).mean())
        if recall >= target:
            return beam, recall
        if beam >= WIDEST:
            return EXACT, 1.0
        beam *= 2


INDEX = "shard int, reps binary, vectors binary, edges binary, start int, beam int, recall double"


def build_index(vectors: DataFrame, k: int = 21, target: float = 0.95, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """A row per shard over all of ``vectors`` (rep, x): its ids, vectors, graph, beam and measured recall; and the shards of each length.

    The second table has a row per length of vectors (size): its first shard's number, and how many it has.
    """
    sizes = vectors.groupBy(F.size("x").alias("size")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    before = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged(sizes.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int")), "sizes")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["shard"]):
            at = borders(t, ["shard"])
            for g in range(len(at) - 1):
                part = t.slice(at[g], at[g + 1] - at[g])
                x = matrix(part["x"])
                graph = Graph(on_sphere(x))
                graph.build()
                beam, recall = fit_beam(graph, x, k, target)
                row = (part["shard"][0].as_py(), part["rep"].to_numpy().astype("<i8").tobytes(), x.astype("<f8").tobytes(), graph.edges.tobytes(), graph.start, beam, recall)
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], c) for v, c in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    total = max(1, sizes.agg(F.sum("shards")).first()[0] or 0)
    dealt = vectors.join(F.broadcast(sizes), F.size("x") == F.col("size"))
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("shards"))).cast("int").alias("shard"), "rep", "x")
    return staged(dealt.repartition(total, "shard").sortWithinPartitions("shard", "rep").mapInArrow(build, INDEX), "index", "uncompressed"), sizes


def search_index(index: DataFrame, sizes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rep and score of the best ``k`` distinct vectors per shard for ``queries`` (query_id, x)."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    shards = max(1, sizes.agg(F.sum("shards")).first()[0] or 0)
    # A shard is read once where there are shards enough for all cores.
    blocks = min(max(1, cores // shards), max(1, queries.count() // BATCH))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the shard whose queries come
        for t in runs(batches, ["shard", "block", "part"]):
            at = borders(t, ["shard", "block", "part"])
            for g in range(len(at) - 1):
                part = t.slice(at[g], at[g + 1] - at[g])
                if part["kind"][0].as_py() == 0:
                    head = part.slice(0, 1).to_pylist()[0]
                    reps = np.frombuffer(head["reps"], "<i8")
                    x = np.frombuffer(head["vectors"], "<f8").reshape(len(reps), -1)
                    held, graph, beam = head["shard"], Graph(on_sphere(x), np.frombuffer(head["edges"], np.int32).reshape(len(reps), -1), head["start"]), head["beam"]
                    part = part.slice(1)
                if not part.num_rows or held != part["shard"][0].as_py():
                    continue
                q, ids = matrix(part["x"]), part["query_id"].to_numpy()
                for i in range(0, len(q), BATCH):
                    own = q[i : i + BATCH]
                    if beam == EXACT:
                        found = np.argsort(-(own @ x.T), axis=1, kind="stable")[:, :k]
                        score = np.einsum("qkd,qd->qk", x[found], own)
                    else:
                        # The whole beam is scored in double precision before it is cut.
                        found = graph.search(queries_on_sphere(own), max(beam, k))[0]
                        score = np.where(found >= 0, np.einsum("qkd,qd->qk", x[found], own), -np.inf)
                        order = np.lexsort((reps[found], -score))[:, :k]
                        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
                    a, b = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + a]), pa.array(reps[found[a, b]]), pa.array(score[a, b])], names=["query_id", "rep", "score"])

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asked = queries.join(F.broadcast(sizes), F.size("x") == F.col("size"))
    shard = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard")
    # A task holds one part of a block's queries at a time.
    part = F.pmod(F.xxhash64("query_id", F.lit("part")), F.lit(max(1, queries.count() // (blocks * QUERY_BLOCK)))).cast("int").alias("part")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    asked = asked.select("query_id", "x", block, part, shard, *[none(c, "binary") for c in ("reps", "vectors", "edges")], none("start", "int"), none("beam", "int"), F.lit(1).alias("kind"))
    held = index.select(none("query_id", "long"), none("x", "array<double>"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).alias("part"), "shard", "reps", "vectors", "edges", "start", "beam", F.lit(0).alias("kind"))
    rows = held.unionByName(asked).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "part", "kind", "query_id")
    return rows.mapInArrow(look, "query_id long, rep long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, target: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score and recall: the ``k`` nearest found of each query among all other rows.

    ``recall`` is the least that a shard measured on its own probes.
    """
    good = usable(rows.select("vec_id", "embedding"), ["vec_id"], "embedding")
    good = staged(good.groupBy("vec_id").agg(F.min("x").alias("x")), "usable")
    same = Window.partitionBy("x").orderBy("vec_id")
    # Of equal vectors only the smallest k + 1 ids can be among the nearest.
    ids = good.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    ids = staged(ids.select("x", "vec_id", "n", F.min("vec_id").over(Window.partitionBy("x")).alias("rep")), "ids")
    index, sizes = build_index(ids.filter("n = 1").select("rep", "x"), k + 1, target)
    queries = good.filter(is_query).select(F.col("vec_id").alias("query_id"), "x")
    found = search_index(index, sizes, queries, k + 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.dropDuplicates(["query_id", "rep"]).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    all_ids = found.select("query_id", "rep", "score").join(ids.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
    recall = index.agg(F.min("recall")).first()[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(recall).cast("double").alias("recall"))

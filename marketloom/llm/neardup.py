"""Near-duplicate vectors by NN-descent.

1. Equal vectors of a label are one node with a number of copies.
2. The neighbour graph starts from all pairs of random-hyperplane buckets, in as many
   tables as a pair at the threshold needs to meet; a large bucket is ordered by
   further signs and compared in overlapping windows. In each
   round a node meets its neighbours' neighbours: the vectors of its forward and
   reverse neighbours come together, and each of them is offered its best partners
   there. A node keeps its best ``k``; a list in which all are near the threshold
   is saturated and doubles, up to ``LONGEST``. Of the edges near the threshold that
   a full list gives up, a spanning forest is kept, so that no group falls apart.
3. Edges near the threshold form candidate groups (connected components). A group's
   core are the members within half the threshold's angle of its pivot: by the triangle
   inequality they all link, so they are counted and not compared. The others are
   compared with all members in double precision, in blocks; a dense group's work
   therefore grows with its size, and no list is as long as the group.
4. Recall is audited after each attempt: random nodes, and those whose best neighbour
   is nearest to the threshold, are compared with all nodes. Below the target, the
   search goes on with new buckets and longer lists; after the last attempt all pairs
   of each label are compared instead, in blocks.

Nodes are spread by id, so a label that holds many rows is spread as well. Rounds
use one-byte codes; their error is within ``SLACK``.

Vectors of different lengths link with nothing of each other. The commonest length, and
each other with more than ``FEW`` distinct vectors, is searched by itself; all pairs
of equal length and label among the rest are compared at once.

Vectors that are null, zero or hold null or non-finite components, and rows with a
null label, link with nothing and stand for themselves; rows with a null id are
returned with null. Repeated rows are copies of each other. An empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.graph import attach, components
from marketloom.llm.groups import borders, forest, runs
from marketloom.llm.jaccard import _blocked, _sides, one_sided
from marketloom.llm.storage import discard, staged
from marketloom.llm.vectors import matrix, usable

#: Rows of a bucket on average, and rows of a bucket that are all compared at once.
BUCKET, WINDOW = 64, 256
#: Further signs by which the rows of a bucket are ordered.
REST = 16
SHORTEST, LONGEST = 16, 64
#: Neighbours that meet at once at a node, and partners each is offered there.
MEETING, OFFERED = 48, 6
SLACK = 0.02
BLOCK = 512
#: Nodes of each kind that an audit compares with all others; random ones are a share of all, from AUDIT up to MOST.
AUDIT, SHARE, MOST = 512, 256, 4096
#: Members of a block where all pairs of a label are compared.
LABEL_BLOCK = 2048
#: Distinct vectors of a length up to which all pairs are compared, unless it's the commonest.
FEW = 4096
NODES = "id long, label long, code binary, k int, near array<long>, sim array<float>, joins array<long>"
OFFERS = "id long, near array<long>, sim array<float>"


def codes(x: np.ndarray) -> np.ndarray:
    """Vectors at unit length, as signed bytes of equal scale."""
    x = x / np.sqrt((x * x).sum(1))[:, None]
    top = np.abs(x).max(1)[:, None]
    return np.concatenate([np.rint(x / top * 127).astype(np.int8), (top / 127).astype(np.float32).view(np.int8)], 1)


def decoded(codes_: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes_), np.int8).reshape(len(codes_), -1)
    x = raw[:, :-4].astype(np.float32)
    return x / np.sqrt((x * x).sum(1))[:, None]


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """Tables of ``bits`` signs in which a pair at the threshold shares a bucket at least once, with the chance ``recall``."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return 1 if together >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - together)))


def _start(nodes: DataFrame, tables: int, seed: int, bits: int, least: float) -> DataFrame:
    """Offers between the members of buckets of equal random-hyperplane signs."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = decoded(batch.column(2).to_pylist())
            rng = np.random.default_rng(seed)
            for table in range(tables):
                planes = rng.standard_normal((x.shape[1], bits + REST)).astype(np.float32)
                sign = x @ planes > 0
                key = sign[:, :bits] @ (1 << np.arange(bits)) + (table << bits)
                rest = sign[:, bits:] @ (1 << np.arange(REST))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(key.astype(np.int64)), pa.array(rest.astype(np.int64))], names=["id", "label", "code", "key", "rest"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["label", "key"]):
            at = borders(t, ["label", "key"])
            ids, x = t["id"].to_numpy(), decoded(t["code"].to_pylist())
            us, vs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for a in range(i, max(j - WINDOW // 2, i + 1), WINDOW // 2):
                    m = min(a + WINDOW, j) - a
                    if m < 2:
                        continue
                    sim = x[a : a + m] @ x[a : a + m].T
                    sim[np.arange(m), np.arange(m)] = -2
                    best = min(OFFERED, m - 1)
                    top = np.argpartition(-sim, best - 1, axis=1)[:, :best]
                    u, v = np.repeat(np.arange(m), best), top.ravel()
                    # More than a row's share are near: what joins them is offered as well.
                    many = np.flatnonzero((sim >= least).sum(1) > best)
                    if len(many):
                        p, q = tree(sim[np.ix_(many, many)] >= least)
                        u, v = np.r_[u, many[p], many[q]], np.r_[v, many[q], many[p]]
                    us.append(ids[a + u])
                    vs.append(ids[a + v])
                    ss.append(sim[u, v])
            yield from _offers(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    spread = nodes.select("id", "label", "code").mapInArrow(signs, "id long, label long, code binary, key long, rest long")
    # Ranges leave usual buckets whole and cut only one that is larger than a partition, by its further signs.
    return spread.repartitionByRange("label", "key", "rest", "id").sortWithinPartitions("label", "key", "rest", "id").mapInArrow(meet, OFFERS)


def tree(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    unseen, us, vs = np.ones(len(linked), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while unseen.any():
        front = np.array([int(unseen.argmax())])
        unseen[front] = False
        while len(front):
            reach = linked[front] & unseen
            new = np.flatnonzero(reach.any(0))
            us.append(front[reach[:, new].argmax(0)])
            vs.append(new)
            unseen[new] = False
            front = new
    return np.concatenate(us), np.concatenate(vs)


def _offers(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(a):
        return
    order = np.argsort(a, kind="stable")
    a, b, sim = a[order], b[order], sim[order]
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    ends = pa.array(np.append(new, len(a)).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(a[new]), pa.ListArray.from_arrays(ends, pa.array(b)), pa.ListArray.from_arrays(ends, pa.array(sim.astype(np.float32)))],
        names=["id", "near", "sim"],
    )


def _take(nodes: DataFrame, offers: DataFrame, least: float) -> DataFrame:
    """Nodes with the best of their lists and of what they are offered."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["id"]):
            at = borders(t, ["id"])
            ids = t["id"].to_numpy()
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            near, sim = t["near"].combine_chunks(), t["sim"].combine_chunks()
            size = np.diff(near.offsets.to_numpy())
            own = np.repeat(owner, size)
            v, s = near.flatten().to_numpy(), sim.flatten().to_numpy()
            ok = v != ids[at[own]]
            own, v, s = own[ok], v[ok], s[ok]
            order = np.lexsort((-s, v, own))
            own, v, s = own[order], v[order], s[order]
            first = np.r_[np.ones(min(1, len(v)), bool), (v[1:] != v[:-1]) | (own[1:] != own[:-1])]
            own, v, s = own[first], v[first], s[first]
            order = np.lexsort((v, -s, own))
            own, v, s = own[order], v[order], s[order]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            k = t["k"].to_numpy(zero_copy_only=False)[at[:-1]].astype(np.int64)
            # A list full of near ones is enlarged at once.
            near_ones = np.bincount(own, s >= least, len(k))
            for _ in range(3):
                k = np.where((near_ones >= k) & (k < LONGEST), k * 2, k)
            keep = place < k[own]
            # What a list gives up near the threshold stays where nothing else joins the two.
            lost = ~keep & (s >= least)
            old = t["joins"].combine_chunks()
            a = np.r_[own[keep & (s >= least)], np.repeat(owner, np.diff(old.offsets.to_numpy())), own[lost]]
            b = np.r_[v[keep & (s >= least)], old.flatten().to_numpy(), v[lost]]
            n_lists = int((keep & (s >= least)).sum())
            names, number = np.unique(np.r_[ids[at[:-1]][a], b], return_inverse=True)
            stay = forest(number[: len(a)], number[len(a) :], len(names)) if len(a) > n_lists else np.zeros(0, np.int64)
            stay = stay[stay >= n_lists]
            stay = stay[np.argsort(a[stay], kind="stable")]
            joined = pa.ListArray.from_arrays(pa.array(np.searchsorted(a[stay], np.arange(len(k) + 1)).astype(np.int32)), pa.array(b[stay]))
            own, v, s = own[keep], v[keep], s[keep]
            ends = pa.array(np.searchsorted(own, np.arange(len(k) + 1)).astype(np.int32))
            head = pa.array(at[:-1])
            yield pa.RecordBatch.from_arrays(
                [t["id"].take(head).combine_chunks(), t["label"].take(head).combine_chunks(), t["code"].take(head).combine_chunks(), pa.array(k.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(v)), pa.ListArray.from_arrays(ends, pa.array(s)), joined],
                names=["id", "label", "code", "k", "near", "sim", "joins"],
            )

    rows = nodes.withColumn("kind", F.lit(0)).unionByName(offers.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.select("id", "kind", "label", "code", "k", "near", "sim", F.coalesce("joins", F.array().cast("array<long>")).alias("joins")).repartition("id").sortWithinPartitions("id", "kind")
    return rows.mapInArrow(best, NODES)


def _meet(nodes: DataFrame) -> DataFrame:
    """What the neighbours of each node, forward and reverse, are offered there."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["at"]):
            at = borders(t, ["at"])
            ids, sim, floor = t["id"].to_numpy(), t["sim"].to_numpy(), t["floor"].to_numpy()
            # Meetings in padded squares; a hub's are as many as its neighbours need, nearest first.
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            keep = np.lexsort((ids, -sim, owner))
            place = np.arange(len(keep)) - at[owner]
            first = np.r_[0, np.cumsum(-(-np.diff(at) // MEETING))]
            owner, place = first[owner] + place // MEETING, place % MEETING
            codes_ = t["code"].combine_chunks().take(pa.array(keep)).to_pylist()
            x = decoded(codes_)
            for g in range(0, int(first[-1]), 256):
                some = slice(*np.searchsorted(owner, [g, g + 256]))
                o, p, k = owner[some] - g, place[some], keep[some]
                if not len(o):
                    continue
                n, m = int(o.max()) + 1, int(p.max()) + 1
                square = np.zeros((n, m, x.shape[1]), np.float32)
                square[o, p] = x[some]
                who = np.full((n, m), -1, np.int64)
                who[o, p] = ids[k]
                least = np.full((n, m), 2.0, np.float32)
                least[o, p] = floor[k]
                s = square @ square.transpose(0, 2, 1)
                s[:, np.arange(m), np.arange(m)] = -2
                s[np.broadcast_to((who < 0)[:, None, :], s.shape)] = -2
                s[s <= least[:, :, None]] = -2
                some_best = min(OFFERED, m)
                top = np.argpartition(-s, some_best - 1, axis=2)[:, :, :some_best]
                value = np.take_along_axis(s, top, 2)
                i, j, c = np.nonzero(value > -2)
                yield from _offers(who[i, j], who[i, top[i, j, c]], value[i, j, c])

    # What a node must beat to enter a list: its last, or anything while there is room.
    floor = F.when(F.size("near") < F.col("k"), F.lit(-1.5)).otherwise(F.array_min("sim")).cast("float")
    edges = nodes.select("id", F.explode(F.arrays_zip("near", "sim")).alias("e")).select("id", F.col("e.near").alias("v"), F.col("e.sim").alias("sim"))
    both = edges.select(F.col("id").alias("at"), F.col("v").alias("id"), "sim").unionByName(edges.select(F.col("v").alias("at"), "id", "sim"))
    told = both.distinct().join(nodes.select("id", "code", floor.alias("floor")), "id")
    return told.repartition("at").sortWithinPartitions("at").mapInArrow(local, OFFERS)


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """In each pair of blocks of a group: links by node (weighted by copies), and spanning edges of links."""
    keys = ["key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = borders(t, keys)
            rep, side, copies = t["rep"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy()
            us, vs, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(at) - 1):
                a, b = (at[k] + y for y in _sides(side[at[k] : at[k + 1]]))
                if not len(a) or not len(b):
                    continue
                # Vectors of a group have one length, those of another may have another.
                x = matrix(t["x"].slice(at[k], at[k + 1] - at[k]))
                x /= np.sqrt((x * x).sum(1))[:, None]
                linked = (x[a - at[k]] @ x[b - at[k]].T >= threshold) & (a[:, None] != b[None, :])
                us.append(rep[a])
                ns.append(linked @ copies[b])
                if one_sided(side, at[k], at[k + 1]):
                    us.append(rep[b])
                    ns.append(copies[a] @ linked)
                vs.append(np.full(sum(map(len, us)) - sum(map(len, vs)), -1))
                i, j = np.nonzero(linked)
                keep = forest(a[i] - at[k], b[j] - at[k], int(at[k + 1] - at[k]))
                us.append(rep[a[i[keep]]])
                vs.append(rep[b[j[keep]]])
                ns.append(np.zeros(len(keep), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (us, vs, ns)], names=["u", "v", "n"])

    return members.mapInArrow(run, "u long, v long, n long")


def _unit_dot(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def _in_groups(members: DataFrame, threshold: float) -> DataFrame:
    """What ``_counted`` gives for the groups of ``members`` (key, rep, copies, x), whose cores are counted without comparing."""
    total = members.count()
    # The pivot is the member with most copies, of those the first.
    pivot = F.max_by("x", F.struct("copies", (-F.col("rep")).alias("low"))).alias("pivot")
    near = attach(members, "key", total, pivot).withColumn("core", F.acos(F.least(F.lit(1.0), _unit_dot(F.col("x"), F.col("pivot")))) <= float(np.arccos(threshold)) / 2 - 1e-6)
    near = staged(near.drop("pivot"), "near")
    sizes = [F.count_if("core").alias("core_size"), F.count_if(~F.col("core")).alias("size"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"), F.min(F.when(F.col("core"), F.col("rep"))).alias("first")]
    sized = staged(attach(near, "key", total, *sizes), "sized")
    none = F.lit(-1).cast("long")
    inside = sized.filter("core").select(F.col("rep").alias("u"), none.alias("v"), (F.col("core_copies") - F.col("copies")).alias("n"))
    joined = sized.filter("core AND rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v"), F.lit(0).cast("long").alias("n"))
    rest = _counted(_blocked(sized.select("key", "size", "core", "core_size", "rep", "copies", "x"), "key", "size", "rep", BLOCK, "core"), threshold)
    return inside.unionByName(joined).unionByName(rest)


def _audit(vectors: DataFrame, nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Share of a sampled node's links that were counted, on average over the sampled nodes that have links."""
    number = min(MOST, max(AUDIT, vectors.count() // SHARE))
    random = vectors.select("rep").orderBy(F.xxhash64("rep", F.lit("audit")), "rep").limit(number)
    off = F.abs(F.array_max("sim") - F.lit(threshold))
    close = nodes.select(F.col("id").alias("rep"), off.alias("off")).filter("off IS NOT NULL").orderBy("off", "rep").limit(AUDIT).select("rep")
    sample = vectors.join(F.broadcast(random.unionByName(close).distinct()), "rep").select("rep", "label", "x").collect()
    if not sample:
        return 1.0
    rep, label = np.array([r["rep"] for r in sample]), np.array([r["label"] for r in sample])
    q = np.array([r["x"] for r in sample])
    q /= np.sqrt((q * q).sum(1))[:, None]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rep), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2))
                x /= np.sqrt((x * x).sum(1))[:, None]
                own, lab, copies = (batch.column(k).to_numpy() for k in (0, 1, 3))
                for i in range(0, len(x), 1024):
                    some = slice(i, i + 1024)
                    total += ((q @ x[some].T >= threshold) & (label[:, None] == lab[some]) & (rep[:, None] != own[some])) @ copies[some]
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total)], names=["rep", "n"])

    true = vectors.select("rep", "label", "x", "copies").mapInArrow(compare, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    found = counted.filter("v = -1").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("found"))
    share = F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("n"))
    got = true.filter("n > 0").join(found, "rep", "left").agg(F.avg(share)).first()[0]
    return 1.0 if got is None else got


def _all_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """What ``_counted`` gives where the vectors of each label and length are one group."""
    keyed = vectors.withColumn("key", F.xxhash64("label", F.size("x")))
    sized = keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    return _counted(_blocked(sized.select("key", "size", "rep", "copies", "x"), "key", "size", "rep", LABEL_BLOCK), threshold)


def _searched(vectors: DataFrame, threshold: float, recall: float, rounds: int, attempts: int) -> DataFrame:
    """What ``_counted`` gives for the links that NN-descent finds among vectors of one length; written to the shared folder."""
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(0, int(np.ceil(np.log2(largest / BUCKET))))
    tables = tables_for(bits, threshold, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pa.array([c.tobytes() for c in codes(matrix(batch.column(2)))], pa.binary())
                n = batch.num_rows
                none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))
                zero = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, pa.array(np.full(n, SHORTEST, np.int32)), none, zero, none], names=["id", "label", "code", "k", "near", "sim", "joins"])

    least = threshold - SLACK
    nodes = staged(vectors.select(F.col("rep").alias("id"), "label", "x").mapInArrow(coded, NODES), "nodes")
    for attempt in range(attempts):
        new = staged(_take(nodes, _start(nodes, tables, attempt + 1, bits, least), least), "nodes")
        discard(nodes)
        nodes = new
        for _ in range(rounds):
            before = nodes.agg(F.sum(F.aggregate("sim", F.lit(0.0), lambda a, s: a + s))).first()[0] or 0.0
            new = staged(_take(nodes, _meet(nodes), least), "nodes")
            discard(nodes)
            nodes = new
            after = nodes.agg(F.sum(F.aggregate("sim", F.lit(0.0), lambda a, s: a + s))).first()[0] or 0.0
            if after - before <= 0.001 * abs(after):
                break
        near = F.transform(F.filter(F.arrays_zip("near", "sim"), lambda e: e["sim"] >= least), lambda e: e["near"])
        edges = nodes.select(F.col("id").alias("u"), F.explode(F.concat(near, "joins")).alias("v"))
        groups = staged(components(edges).withColumnsRenamed({"node": "rep", "component": "key"}), "groups")
        members = staged(groups.join(vectors, "rep").select("key", "rep", "copies", "x"), "members")
        counted = staged(_in_groups(members, threshold), "counted")
        discard(groups, members)
        if _audit(vectors, nodes, counted, threshold) >= recall:
            return counted
        nodes = nodes.withColumn("k", F.least(F.col("k") * 2, F.lit(LONGEST)).cast("int"))
    return staged(_all_pairs(vectors, threshold), "counted")


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.93, recall: float = 0.999, rounds: int = 4, attempts: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding, label."""
    given = rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    good = usable(given.filter("label IS NOT NULL"), ["vec_id", "label"], "embedding")
    vectors = staged(good.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    size = F.size("x")
    sizes = vectors.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # Lengths with many vectors, the commonest first; it is searched whatever its number.
    common = sizes.orderBy(F.desc("n"), "size").limit(1)
    many = [r["size"] for r in common.unionByName(sizes.filter(F.col("n") > FEW)).distinct().orderBy(F.desc("n"), "size").collect()]
    if len(many) > 1 or sizes.count() > 1:
        found = [_searched(vectors.filter(size == n), threshold, recall, rounds, attempts) for n in many]
        counted = staged(_all_pairs(vectors.filter(~size.isin(many)), threshold), "counted")
        for one in found:
            counted = counted.unionByName(one)
    else:
        counted = _searched(vectors, threshold, recall, rounds, attempts)
    links = counted.filter("v = -1").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("other"))
    joined = components(counted.filter("v <> -1").select("u", "v")).withColumnRenamed("node", "rep")
    told = vectors.join(links, "rep", "left").join(joined, "rep", "left")
    told = told.select("label", "x", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
    told = good.join(told, ["label", "x"]).select("vec_id", "component_id", "n_links")
    # One row a given row: those that took no part stand for themselves.
    own = given.groupBy("vec_id").agg(F.count(F.lit(1)).alias("times"))
    best = told.groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = own.join(best, "vec_id", "left").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

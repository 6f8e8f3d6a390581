"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Texts become sets of hashed shingles of five lower-cased words (a shorter text
   is one shingle of all its words). Texts with equal sets are one class with a
   number of copies; classes, told apart by 128 bits of their set, go on.
2. A class's MinHash values are dealt over ``TREES`` prefix tries of ``DEEPEST``
   levels. A path through a trie is one long integer, the first level in its highest
   bits: sorted paths are the trie, and a shorter prefix is a shift to the right.
3. The prefix by which classes are matched starts at the deepest level and is
   shortened level by level until the recall of an audit meets the target. The audit
   compares a bounded number of classes with the signatures of all, those that may link
   exactly, and finds for each link at which levels the two meet (``matching_depth``).
4. Classes under equal prefixes are compared by whole signatures. Pairs clearly
   below the threshold (by 4.5 deviations) are put off; a spanning forest of the
   rest is enough to find candidate groups, as connected components.
5. Within a candidate group all pairs are verified on their whole shingle sets.

Prefix groups and candidate groups with many members are dealt over blocks, and
each pair of blocks is a task's unit; only counts and spanning forests leave it,
never the pairs of a group.

Null texts and texts without a word have no shingles and link with nothing; very
long texts are taken whole; repeated rows are copies of each other; rows of one id
with different texts are different documents; rows with a null id link like others
and come back with null. An empty table gives no rows. Only doc_id and text are
read. Shingles are 64-bit and sets 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.graph import attach, components
from marketloom.llm.groups import binaries, borders, forest, runs
from marketloom.llm.names import free_names
from marketloom.llm.storage import discard, staged
from marketloom.llm.textops import LOWER, Hasher, lean, mix, parts, segments, spaced, words

TREES, DEEPEST = 24, 6
#: Bits of a trie's level.
LEVEL = 9
SLACK = 0.15
#: Members of a prefix group, and of a candidate group, in one block.
PREFIX_BLOCK, SET_BLOCK = 512, 256
#: Classes that the audit compares with all texts: those that meet another at AUDIT_DEPTH in one of AUDIT_TREES, and any others.
AUDIT_LIKELY, AUDIT_ANY, AUDIT_DEPTH, AUDIT_TREES = 192, 64, 4, 8
#: Shingles of all audited classes together.
AUDIT_SHINGLES = 2_000_000
#: Classes that an audited one is compared with exactly, and how far below the threshold their signatures may agree.
AUDIT_PARTNERS, AUDIT_SLACK = 32, 0.25
#: Bytes of text that are cut into shingles together, and whose sets are held together; a longer text is taken alone, its words part by part.
STEP, PART = 500_000, 2_000_000
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TREES * DEEPEST, dtype=np.uint64)


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, and the words' text numbers."""
    data = LOWER[data]
    start, end, owner = words(data, offsets)
    return Hasher(data).spans(start, end), owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the n + 1 offsets."""
    n = len(offsets) - 1
    parts, sizes = [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
    for i, j in segments(offsets, STEP):
        if j - i == 1 and offsets[j] - offsets[i] > STEP:
            h = np.concatenate([_words_of(p, np.array([0, len(p)]))[0] for p in (data[offsets[i] + a : offsets[i] + b] for a, b in spaced(data[offsets[i] : offsets[j]], STEP))])
            count = np.array([len(h)])
        else:
            h, owner = _words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            count = np.bincount(owner, minlength=j - i)
        first = np.cumsum(count) - count
        m = max(len(h) - width + 1, 0)
        rolled = h[:m].copy()
        for k in range(1, width):
            rolled = rolled * np.uint64(0x100000001B3) + h[k : m + k]
        rolled = mix(rolled)
        for t in np.flatnonzero(count):
            a, c = first[t], count[t]
            if c >= width:
                own = np.unique(rolled[a : a + c - width + 1])
            else:
                whole = np.uint64(c)
                for x in h[a : a + c]:
                    whole = np.uint64((int(whole) * 0x100000001B3 + int(x)) & (2**64 - 1))
                own = mix(np.array([whole], np.uint64))
            parts.append(own)
            sizes[i + t] = len(own)
    return np.concatenate(parts), np.append(0, np.cumsum(sizes))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 32-bit minima per set; sets are not empty."""
    out = np.empty((len(offsets) - 1, len(_MULTIPLY)), np.uint32)
    for i, j in segments(offsets, 100_000):
        own, first = sets[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        for k in range(len(_MULTIPLY)):
            out[i:j, k] = np.minimum.reduceat(own * _MULTIPLY[k] + _ADD[k], first) >> np.uint64(32)
    return out


def tries(signature: np.ndarray) -> np.ndarray:
    """A row per set: its path through each trie, as a sortable integer (trie, first level, second level ...)."""
    s = signature.reshape(len(signature), TREES, DEEPEST).astype(np.int64) >> 8 & (1 << LEVEL) - 1
    key = np.broadcast_to(np.arange(TREES, dtype=np.int64), s.shape[:2])
    for k in range(DEEPEST):
        key = key << LEVEL | s[:, :, k]
    return key


def common_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest prefix that two rows of paths share in some trie."""
    apart = a ^ b
    return sum((apart >> LEVEL * (DEEPEST - d) == 0).any(1).astype(np.int64) for d in range(1, DEEPEST + 1))


SIGNED = "doc_id long, h1 long, h2 long, n int, signature binary, tries array<long>"


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in (p for b in lean(batches) for p in parts(b, 1, PART)):
            sets, at = shingle_sets(data, offsets, width)
            some = np.flatnonzero(np.diff(at))
            first = at[some]
            h1, h2 = _names(sets, first)
            sig = signatures(sets, np.append(first, len(sets))) if len(some) else np.zeros((0, TREES * DEEPEST), np.uint32)
            paths = pa.array(tries(sig).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)), pa.array(h1), pa.array(h2), pa.array(np.diff(at)[some].astype(np.int32)),
                    pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * TREES), paths),
                ],
                names=[c.split()[0] for c in SIGNED.split(", ")],
            )

    return docs.mapInArrow(run, SIGNED)


def _names(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set that begins at ``first``, as two columns."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.add.reduceat(mix(sets), first).view(np.int64), np.add.reduceat(mix(sets * np.uint64(3) + np.uint64(1)), first).view(np.int64)


def expected(j: np.ndarray, depth: int) -> np.ndarray:
    """The chance that sets of similarity ``j`` share a prefix of ``depth`` levels in some trie."""
    return 1 - (1 - j**depth) ** TREES


def _partners(reps: DataFrame, own: np.ndarray, names: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """For each audited class (row of signatures ``own``, of ``names``) up to AUDIT_PARTNERS others of alike signatures: audited class, h1, h2, rep."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Those of smallest hash for each audited class so far: own, h1, h2, rep, hash.
        kept = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, _ = binaries(pa.chunked_array([batch.column(3)]), "u1")
            sig = sig.reshape(batch.num_rows, -1)
            h1, h2, rep = (batch.column(k).to_numpy() for k in range(3))
            for i in range(0, len(sig), 128):
                same = np.zeros((len(sig[i : i + 128]), len(own)), np.uint8)
                # Signatures have at most 255 places, so counts fit a byte.
                for k in range(own.shape[1]):
                    same += sig[i : i + 128, k, None] == own[None, :, k]
                x, y = np.nonzero(same >= least * own.shape[1])
                x += i
                other = (h1[x] != names[y, 0]) | (h2[x] != names[y, 1])
                x, y = x[other], y[other]
                if not len(x):
                    continue
                hashed = mix(h1[x].view(np.uint64) ^ mix(y.astype(np.uint64)))
                kept = [np.concatenate(p) for p in zip(kept, (y, h1[x], h2[x], rep[x], hashed), strict=True)]
                by = np.lexsort((kept[4], kept[0]))
                by = by[np.arange(len(by)) - np.searchsorted(kept[0][by], kept[0][by]) < AUDIT_PARTNERS]
                kept = [p[by] for p in kept]
        yield pa.RecordBatch.from_arrays([*map(pa.array, kept[:4]), pa.array(kept[4].view(np.int64))], names=["own", "h1", "h2", "rep", "hash"])

    # Each task gives a bounded number of rows for each of a bounded number of classes.
    pairs = reps.filter("rep IS NOT NULL").select("h1", "h2", "rep", "signature").mapInArrow(near, "own long, h1 long, h2 long, rep long, hash long")
    few = pairs.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy("hash", "h1", "h2"))).filter(F.col("place") <= AUDIT_PARTNERS)
    return [tuple(r) for r in few.select("own", "h1", "h2", "rep").collect()]


def _audited(docs: DataFrame, reps: DataFrame, threshold: float, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per audited class with links: the share of links that meet at each level, and the share expected of their similarities.

    Audited classes are compared with every class's signature; texts of a bounded number of
    those that may link (by 7.5 deviations) are read again and compared exactly, on whole
    shingle sets.
    """
    path = F.explode(F.slice("tries", 1, AUDIT_TREES))
    short = reps.select("node", path.alias("key")).withColumn("key", F.shiftright("key", LEVEL * (DEEPEST - AUDIT_DEPTH)))
    order = F.xxhash64("node", F.lit("audit"))
    # One of each prefix group, so that a large group doesn't take all places.
    met = short.groupBy("key").agg(F.min_by("node", order).alias("node"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = met.select("node").distinct().orderBy(order).limit(AUDIT_LIKELY)
    other = reps.select("node").orderBy(order).limit(AUDIT_ANY)
    chosen = reps.join(F.broadcast(met.unionByName(other).distinct()), "node").filter("rep IS NOT NULL").select("rep", "h1", "h2", "n", "signature")
    # Only what is kept counts towards the bound: a class too large for it leaves the others' audit whole.
    rows, total = [], 0
    for r in sorted(chosen.collect(), key=lambda r: (r["n"] > AUDIT_SHINGLES // 8, r["rep"], r["h1"], r["h2"])):
        if not rows or total + r["n"] <= AUDIT_SHINGLES:
            total += r["n"]
            rows.append(r)
    if not rows:
        return []
    names = np.array([(r["h1"], r["h2"]) for r in rows], np.int64)
    pairs = _partners(reps, np.stack([np.frombuffer(r["signature"], np.uint8) for r in rows]), names, threshold - AUDIT_SLACK)
    if not pairs:
        return []
    # At most AUDIT_PARTNERS + 1 for each audited class.
    ids = sorted({r["rep"] for r in rows} | {rep for *_, rep in pairs})
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    sets = staged(_sets(docs.join(F.broadcast(wanted), "doc_id"), width).dropDuplicates(["h1", "h2"]), "audit")
    mine = docs.sparkSession.createDataFrame([tuple(map(int, n)) for n in names], "h1 long, h2 long")
    held = {(r["h1"], r["h2"]): np.frombuffer(r["shingles"], "<u8") for r in sets.join(F.broadcast(mine), ["h1", "h2"]).collect()}
    own = [held.get((r["h1"], r["h2"]), np.zeros(0, np.uint64)) for r in rows]
    sizes = np.array([len(x) for x in own])
    paths = np.zeros((len(own), TREES), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        paths[some] = tries(signatures(np.concatenate([own[k] for k in some]), np.append(0, np.cumsum(sizes[some]))))
    asked: dict[tuple[int, int], list[int]] = {}
    for k, h1, h2, _ in pairs:
        if sizes[k]:
            asked.setdefault((h1, h2), []).append(k)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found, chance = (np.zeros((len(own), DEEPEST)) for _ in range(3))
        for batch in lean(batches):
            for h1, h2, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                set_, path = np.frombuffer(blob.as_buffer(), "<u8"), None
                for k in asked.get((h1, h2), ()):
                    at = np.minimum(np.searchsorted(own[k], set_), sizes[k] - 1)
                    both = int((own[k][at] == set_).sum())
                    similarity = both / (sizes[k] + len(set_) - both)
                    if similarity < threshold - 1e-6:
                        continue
                    if path is None:
                        path = tries(signatures(set_, np.array([0, len(set_)])))
                    level = int(common_levels(path, paths[k : k + 1])[0])
                    for d in range(DEEPEST):
                        n[k, d] += 1
                        found[k, d] += level > d
                        chance[k, d] += expected(np.array(similarity), d + 1)
        some = np.flatnonzero(n[:, 0])
        lists = [pa.array([r.tolist() for r in m[some]], pa.list_(pa.float64())) for m in (found, chance)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some, 0]), *lists], names=["own", "n", "found", "chance"])

    seen = sets.select("h1", "h2", "shingles").mapInArrow(compare, "own long, n double, found array<double>, chance array<double>")
    sums = [F.array(*[F.sum(F.col(c)[d]) for d in range(DEEPEST)]).alias(c) for c in ("found", "chance")]
    told = seen.groupBy("own").agg(F.sum("n").alias("n"), *sums).collect()
    discard(sets)
    return [(np.array(r["found"]) / r["n"], np.array(r["chance"]) / r["n"]) for r in told]


def matching_depth(audited: list[tuple[np.ndarray, np.ndarray]], threshold: float, recall: float) -> int:
    """The longest prefix that meets the target, going up from the deepest level.

    At a level, the links of the audited classes must meet with the target recall, both
    as measured and as expected of links of their similarities, on average over the
    classes. Where no audited class has a link, links are taken to be at the threshold.
    """
    depth = DEEPEST
    while depth > 1:
        if audited:
            got = min(float(np.mean([a[k][depth - 1] for a in audited])) for k in (0, 1))
        else:
            got = float(expected(np.array([threshold]), depth)[0])
        if got >= recall:
            break
        depth -= 1
    return depth


def _blocked(rows: DataFrame, key: str, size: str, member: str, block: int, core: str | None = None) -> DataFrame:
    """Rows with the pairs of blocks (one, two) of their group that they take part in, and their side (0, 1, or 2 for both).

    ``core`` marks rows that needn't meet each other, of which ``size`` counts only the
    rest: these have the first blocks, which all rows meet.
    """
    n = F.ceil(F.col(size) / block)
    if core is None:
        last = n - 1
        own = F.pmod(F.xxhash64(member), n)
    else:
        cores = F.ceil(F.col(f"{core}_size") / block)
        last = F.when(F.col(core), n - 1).otherwise(n + cores - 1)
        own = F.when(F.col(core), n + F.pmod(F.xxhash64(member), cores)).otherwise(F.pmod(F.xxhash64(member), n))
        # A core row without other rows beside it meets none.
        rows = rows.filter(F.col(size) > 0)
    at = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    at = at.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other"), "side": side.cast("int")}).drop("own", "other")
    return at.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that agree in a share of ``least`` places."""
    u, v = [], []
    for i in range(0, len(a), 16):
        same = (a[i : i + 16, None, :] == b[None, :, :]).sum(2, dtype=np.int32) >= least * a.shape[1]
        x, y = np.nonzero(same)
        u.append(x + i)
        v.append(y)
    return np.concatenate(u), np.concatenate(v)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _candidate_edges(members: DataFrame, least: float) -> DataFrame:
    keys = ["key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(lean(batches), keys):
            at = borders(t, keys)
            node, side = t["node"].to_numpy(), t["side"].to_numpy()
            sig, _ = binaries(t["signature"], "u1")
            sig = sig.reshape(len(node), -1)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            size = np.diff(at)
            two = at[:-1][size == 2]
            two = two[(side[two] == 2)]
            ok = (sig[two] == sig[two + 1]).mean(1) >= least
            us.append(node[two[ok]])
            vs.append(node[two[ok] + 1])
            for k in np.flatnonzero((size > 2) | ((size == 2) & (side[at[:-1]] != 2))):
                a, b = (at[k] + x for x in _sides(side[at[k] : at[k + 1]]))
                if not len(a) or not len(b):
                    continue
                x, y = _alike(sig[a], sig[b], least)
                x, y = a[x], b[y]
                x, y = x[x != y], y[x != y]
                keep = forest(x - at[k], y - at[k], int(size[k]))
                us.append(node[x[keep]])
                vs.append(node[y[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return members.mapInArrow(run, "u long, v long")


def _overlaps(sets: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``a`` with sets ``b``, by products of incidence matrices."""

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([sets[offsets[r] : offsets[r + 1]] for r in rows]), np.repeat(np.arange(len(rows)), np.diff(offsets)[rows])

    (xa, ra), (xb, rb) = part(a), part(b)
    common = np.intersect1d(xa, xb)
    ia, ib = np.searchsorted(common, xa), np.searchsorted(common, xb)
    oka, okb = common[np.minimum(ia, len(common) - 1)] == xa, common[np.minimum(ib, len(common) - 1)] == xb
    ia, ra, ib, rb = ia[oka], ra[oka], ib[okb], rb[okb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ia, ra, ib, rb = ia[oa], ra[oa], ib[ob], rb[ob]
    total = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, len(common), 4096):
        m = min(4096, len(common) - c)
        sa, sb = slice(*np.searchsorted(ia, [c, c + m])), slice(*np.searchsorted(ib, [c, c + m]))
        left, right = np.zeros((len(a), m), np.float32), np.zeros((m, len(b)), np.float32)
        left[ra[sa], ia[sa] - c] = 1
        right[ib[sb] - c, rb[sb]] = 1
        total += left @ right
    return total


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """Per class and pair of blocks its links' number of documents; and spanning edges of the links."""
    keys = ["key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(lean(batches), keys):
            at = borders(t, keys)
            node, side, copies = t["node"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy()
            sets, offsets = binaries(t["shingles"], "<u8")
            us, vs, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(at) - 1):
                a, b = (at[k] + x for x in _sides(side[at[k] : at[k + 1]]))
                if not len(a) or not len(b) or (len(a) == 1 and len(b) == 1 and a[0] == b[0]):
                    continue
                size = np.diff(offsets)
                both = _overlaps(sets, offsets, a, b)
                linked = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-6
                linked &= a[:, None] != b[None, :]
                us += [node[a], node[b]] if one_sided(side, at[k], at[k + 1]) else [node[a]]
                none = np.full(len(a), -1)
                if one_sided(side, at[k], at[k + 1]):
                    vs += [none, np.full(len(b), -1)]
                    ns += [linked @ copies[b], copies[a] @ linked]
                else:
                    vs.append(none)
                    ns.append(linked @ copies[b])
                x, y = np.nonzero(linked)
                x, y = a[x], b[y]
                keep = forest(x - at[k], y - at[k], int(at[k + 1] - at[k]))
                us.append(node[x[keep]])
                vs.append(node[y[keep]])
                ns.append(np.zeros(len(keep), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ns).astype(np.int64))], names=["u", "v", "n"]
            )

    return members.mapInArrow(run, "u long, v long, n long")


def one_sided(side: np.ndarray, i: int, j: int) -> bool:
    """Whether the rows are two different blocks, so that both count the links."""
    return bool((side[i:j] != 2).any())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept.

    ``class_id`` is the smallest doc_id reachable by links (pairs of documents
    with Jaccard similarity of at least ``threshold``), ``n_links`` counts the other
    documents linked directly, ``kept`` marks the document that stands for its
    class. A text without shingles is a class of its own, of its doc_id. A class in
    which all ids are null has a null class_id, and all its rows are marked.
    """
    return _told(docs, threshold, width, recall)[0].select("doc_id", "class_id", "n_links", "kept")


def _told(docs: DataFrame, threshold: float, width: int, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """``near_duplicates`` with the set's name (h1, h2; null without shingles) and component; and the staged frames it reads."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(_signed(docs, width), "signed")
    whole = signed.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("tries").alias("tries"),
    )
    # Equal sets have equal signatures, so any copy's will do.
    reps = staged(whole.withColumn("node", F.monotonically_increasing_id()), "reps")
    classes = reps.select("node", "h1", "h2", "rep", "copies")
    number = reps.count()
    depth = matching_depth(_audited(docs, reps, threshold, width), threshold, recall)
    entries = reps.select("node", F.explode("tries").alias("key")).withColumn("key", F.shiftright("key", LEVEL * (DEEPEST - depth)))
    shared = attach(entries, "key", number * TREES, F.count(F.lit(1)).alias("size"), least=2)
    members = shared.join(reps.select("node", "signature"), "node")
    edges = _candidate_edges(_blocked(members, "key", "size", "node", PREFIX_BLOCK), threshold - SLACK)
    groups = staged(components(edges).withColumnsRenamed({"component": "key"}), "groups")
    sized = staged(attach(groups, "key", groups.count(), F.count(F.lit(1)).alias("size")).join(classes, "node"), "sized")
    sets = _sets_of(docs, sized, width)
    found = staged(_verified(_blocked(sets, "key", "size", "node", SET_BLOCK), threshold), "verified")
    links = found.filter("v = -1").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("other"))
    joined = components(found.filter("v <> -1").select("u", "v"))
    other = F.coalesce("other", F.lit(0))
    each = classes.join(links, "node", "left").join(joined, "node", "left").select(
        "node", "h1", "h2", "rep", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + other).alias("n_links")
    )
    each = staged(each, "each")
    told = staged(attach(each, "component", number, F.min("rep").alias("class_id")), "told")
    discard(reps, groups, sized, found, each)
    with_sets = signed.select("doc_id", "h1", "h2").join(told, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "h1", "h2", "component")
    none = [F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "component")]
    without = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), *none
    )
    return with_sets.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))), [signed, told]


def _sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``classes`` (h1, h2, rep and more) with their whole shingle sets, made again from a text of each."""
    named = docs.join(classes.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    unnamed = docs.filter("doc_id IS NULL")
    made = _sets(named.unionByName(unnamed), width).dropDuplicates(["h1", "h2"])
    return made.join(classes, ["h1", "h2"])


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """h1, h2 and the whole shingle set of texts that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in (p for b in lean(batches) for p in parts(b, 0, PART)):
            sets, at = shingle_sets(data, offsets, width)
            some = np.flatnonzero(np.diff(at))
            h1, h2 = _names(sets, at[some])
            made = pa.array([sets[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), made], names=["h1", "h2", "shingles"])

    return texts.select("text").mapInArrow(run, "h1 long, h2 long, shingles binary")


def _named(docs: DataFrame, width: int, h1: str, h2: str) -> DataFrame:
    """``docs`` with the name of each text's set in two more columns; null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in (p for b in lean(batches) for p in parts(b, b.schema.get_field_index("text"), PART)):
            sets, at = shingle_sets(data, offsets, width)
            some = np.flatnonzero(np.diff(at))
            one, two = np.zeros((2, len(offsets) - 1), np.int64)
            one[some], two[some] = _names(sets, at[some])
            none = np.diff(at) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, mask=none), pa.array(two, mask=none)], names=[*batch.schema.names, h1, h2])

    return docs.mapInArrow(run, docs.withColumns({h: F.lit(None).cast("long") for h in (h1, h2)}).schema)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """``docs`` less all but one document of each class, that of the smallest doc_id.

    Of repeated rows (equal id and shingles) one stays; rows of one id with different
    texts are different documents. A class without any id keeps one row. Texts
    without shingles stay, one for each id that is not null.
    """
    made, needed = _told(docs, threshold, width, recall)
    told = staged(made, "near")
    discard(*needed)
    stays, times, own, h1, h2, key = free_names(docs, "stays", "times", "own", "h1", "h2", "key")
    ids = told.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.bool_and("kept").alias(stays), F.count(F.lit(1)).alias(times))
    # Documents are shuffled once, at every size: the merge hint keeps small inputs from another plan.
    named = docs.withColumn(key, F.col("doc_id").cast("long"))
    left = named.join(ids.hint("merge"), key)
    once = left.filter(F.col(times) == 1).filter(F.col(stays)).select(*docs.columns)
    # Rows that share their id, or have none, are told apart by their sets.
    again = left.filter(F.col(times) > 1).select(*docs.columns, key)
    rows = _named(again.unionByName(named.filter(F.col(key).isNull())), width, h1, h2)
    empty = rows.filter(F.col(h1).isNull())
    classes = told.filter("h1 IS NOT NULL").groupBy("component", "h1", "h2").agg(F.min("doc_id").alias("least"), F.max("class_id").alias("class_id"))
    by = F.struct(F.col("class_id").isNotNull() & ~F.col("least").eqNullSafe(F.col("class_id")), "h1", "h2")
    best = classes.groupBy("component").agg(F.min_by(F.struct("h1", "h2", "class_id"), by).alias("b"))
    best = best.select(F.col("b.h1").alias(h1), F.col("b.h2").alias(h2), F.col("b.class_id").alias(own))
    kept = rows.join(best, [h1, h2]).filter(F.col(key).eqNullSafe(F.col(own)))
    kept = kept.dropDuplicates([h1, h2]).select(*docs.columns)
    blank = empty.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(empty.filter(F.col(key).isNull()))
    return once.unionByName(kept).unionByName(blank.select(*docs.columns))

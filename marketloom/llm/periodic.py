"""Periodic runs of words: stretches that repeat with a period, four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least ``max(6, 4 q)`` words, that no neighbouring word extends.

Harmonic grid probing finds all of them. Within a run of period p, at least 3 p words
in a row equal the word p behind them, so at three grid points in a row, jp, (j+1)p and
(j+2)p, the word equals the next grid point's. Probing every period's grid takes
n + n/2 + n/3 + ... comparisons. Grid points that survive are extended in both
directions by comparing chunks of growing length; those within a run found before,
whose period divides p, are skipped, as they lead to that run again. Periods go up, so
the run that is found first has the smallest period.

The texts of a batch are probed together, longest first, with a word between them
that equals no other; a period looks only at texts long enough for it. Nothing is
shuffled. Words are told apart by 64-bit hashes of their bytes.

Null and empty texts, and texts without a run, have an empty list; a very long text is
taken alone, whole. Repeated rows have the same runs; a null id is carried along. An
empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.textops import Hasher, joined, lean, mix, parts, words

LEAST, TIMES = 6, 4
#: Bytes of text that are probed together; a longer text is taken alone.
STEP = 1_000_000
#: Periods below it are probed one by one, the others in blocks of about PROBES grid points.
SINGLE, PROBES = 48, 200_000
#: Words that an extension compares first; each further chunk is twice as long, up to the last number.
CHUNK, CHUNK_MOST = 32, 1 << 20
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _grid_survivors(code: np.ndarray, reach: np.ndarray, periods: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each period with any: the grid points that equal the next one and belong to three such in a row.

    ``reach[p]`` is how many words lie in texts long enough for period p.
    """
    for p in periods[periods < SINGLE].tolist():
        grid = code[: reach[p] : p]
        same = grid[1:] == grid[:-1]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(three):
            yield p, _with_next(three) * p
    rest = periods[periods >= SINGLE]
    counts = -(-reach[rest] // rest)
    ends = np.cumsum(counts)
    i = 0
    while i < len(rest):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PROBES, "right")))
        n = counts[i:j]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        grid = code[place * np.repeat(rest[i:j], n)]
        same = np.append(grid[1:] == grid[:-1], False)
        same[first[1:] - 1] = False  # the next grid point is another period's
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(three):
            owner = np.searchsorted(first, three, "right") - 1
            for k in np.unique(owner).tolist():
                yield int(rest[i + k]), _with_next(place[three[owner == k]]) * int(rest[i + k])
        i = j


def _with_next(three: np.ndarray) -> np.ndarray:
    """The grid points of all triples that begin at ``three``."""
    return np.unique((three[:, None] + np.arange(3)).ravel())


def _extent(code: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which every word equals the one p further on."""
    n = len(code) - p
    end, chunk = at + 1, CHUNK
    while end < n:
        apart = np.flatnonzero(code[end : min(end + chunk, n)] != code[end + p : min(end + chunk, n) + p])
        if len(apart):
            end += int(apart[0])
            break
        end, chunk = min(end + chunk, n), min(2 * chunk, CHUNK_MOST)
    start, chunk = at, CHUNK
    while start > 0:
        low = max(start - chunk, 0)
        apart = np.flatnonzero(code[low:start] != code[low + p : start + p])
        if len(apart):
            start = low + int(apart[-1]) + 1
            break
        start, chunk = low, min(2 * chunk, CHUNK_MOST)
    return start, end


class _Found:
    """Runs found so far; those around a place are looked up in buckets of BUCKET words."""

    BUCKET = 256

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self.held: set[tuple[int, int]] = set()
        self.near: dict[int, list[int]] = {}
        # A run over many buckets is kept apart, so that it isn't entered into each.
        self.wide: list[int] = []

    def add(self, start: int, end: int, p: int) -> None:
        if (start, end) not in self.held:
            self.held.add((start, end))
            self.runs.append((start, end, p))
            if end - start > 64 * self.BUCKET:
                self.wide.append(len(self.runs) - 1)
            else:
                for b in range(start // self.BUCKET, (end - 1) // self.BUCKET + 1):
                    self.near.setdefault(b, []).append(len(self.runs) - 1)

    def around(self, at: int, p: int) -> int:
        """The end of a found run that holds ``at`` and the word p further on, and whose period divides p; or 0."""
        for k in (*self.near.get(at // self.BUCKET, ()), *self.wide):
            start, end, q = self.runs[k]
            if start <= at and at + p < end and p % q == 0:
                return end
        return 0


def runs_of(code: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``n`` texts whose word codes lie in order: rows (text, start, length, period) by text, start and period; and the number of words of each."""
    size = np.bincount(owner, minlength=n)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= LEAST]
    if not len(order):
        return np.zeros((0, 4), np.int64), size
    first = np.cumsum(size) - size
    # Each text is followed by a word of its own.
    length = size[order] + 1
    begin = np.cumsum(length) - length
    total = int(length.sum())
    flat = np.empty(total, np.uint64)
    inside = np.ones(total, bool)
    inside[begin + length - 1] = False
    flat[~inside] = mix(np.arange(len(order), dtype=np.uint64) + np.uint64(0x51ED270B))
    flat[inside] = np.concatenate([code[a : a + s] for a, s in zip(first[order].tolist(), size[order].tolist(), strict=True)])
    periods = np.arange(1, int(size[order[0]]) // TIMES + 1)
    # Texts of at least 4 p words come first: how far they reach.
    enough = np.searchsorted(-size[order], -TIMES * np.arange(len(periods) + 1), "right")
    reach = np.append(begin, total)[enough]
    found = _Found()
    for p, points in _grid_survivors(flat, reach, periods):
        past = 0
        for at in points.tolist():
            if at < past:
                continue
            past = found.around(at, p) - p
            if past <= at:
                start, end = _extent(flat, at, p)
                past = end
                if end + p - start >= max(LEAST, TIMES * p):
                    found.add(start, end + p, p)
    if not found.runs:
        return np.zeros((0, 4), np.int64), size
    runs = np.array(found.runs, np.int64)
    text = np.searchsorted(begin, runs[:, 0], "right") - 1
    out = np.stack([order[text], runs[:, 0] - begin[text], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], size


def find_runs(docs: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``doc_id``, ``text`` and other columns of ``docs`` with its runs (start, length, period; by start, then period) and collapsed text.

    The collapsed text leaves out each word that some run contains after the run's
    first period, and has one blank between words. Columns of these two names are replaced.
    """
    docs = docs.drop(runs, collapsed)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in (p for b in lean(batches) for p in parts(b, b.schema.get_field_index("text"), STEP)):
            n = len(offsets) - 1
            start, end, owner = words(data, offsets)
            found, size = runs_of(Hasher(data).spans(start, end), owner, n)
            base = (np.cumsum(size) - size)[found[:, 0]] + found[:, 1]
            drop = np.zeros(len(start) + 1, np.int64)
            np.add.at(drop, base + found[:, 3], 1)
            np.add.at(drop, base + found[:, 2], -1)
            keep = np.cumsum(drop[:-1]) == 0
            lists = np.append(0, np.cumsum(np.bincount(found[:, 0], minlength=n))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)], fields=list(kind.value_type))
            text = joined(data, start[keep], end[keep], owner[keep], n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(lists, rows), text.cast(pa.string())], names=[*batch.schema.names, runs, collapsed])

    schema = T.StructType([*docs.schema.fields, T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())])
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its runs' number, the longest of them (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    found = find_runs(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # The largest of (length, -start, -period).
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) DIV (-best.period)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

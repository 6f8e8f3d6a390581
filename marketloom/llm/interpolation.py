"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

    P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1)

The mixture (l2, l1, l0) depends on the bucket of log2(c(v) + 1). It is learned by
expectation-maximisation on the counts of one fold of the training documents, with
that fold deleted from the estimates. Scores then use the counts of all training
documents. Words are runs without ASCII white space, A-Z lower-cased; each text
ends with an end token, which is also the context of its first word.

How it runs: texts are cut into chunks of about ``CHUNK`` tokens and stored as
numbers of each chunk's own vocabulary. A chunk sends its distinct words, then its
distinct bigrams, with counts, to the range of the hash space they lie in; a task
adds up a range over all chunks and answers each chunk with the totals. So a
frequent word or bigram is one entry per chunk, nothing is collected but totals and
the held-out histogram (on a fixed logarithmic grid), and scores are made where
the chunk lies. Words and bigrams are told apart by 64-bit hashes (of all their bytes).

Chunks and ranges both grow with the square root of the input, so messages between
them grow with the input and not with its square, up to ``GROWTH`` times their
least size, which bounds what a task holds.

Null texts are empty: one end token. A very long text is cut into words part by part;
its tokens stay in one chunk. A null doc_id has the remainder of empty
text. Repeated rows count and score each. An empty table gives no rows; without a
training document, all counts are zero. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.groups import borders, runs
from marketloom.llm.storage import staged
from marketloom.llm.textops import LOWER, Hasher, flat, lean, mix, split, words

CHUNK = 2_000_000
#: Tokens for each range of the hash space.
RANGE_TOKENS = 1_500_000
#: Bytes of text from which on both grow, and how many times at most.
GROWS_FROM, GROWTH = 2_000_000_000, 8
STEP = 1_000_000
FOLDS, HELD_OUT, DELETED = 10, 0, 1
END = np.uint64(0x5BD1E995C0FFEE11)
#: Steps of the logarithmic grid per doubling; buckets of contexts are doublings.
GRID, BUCKETS = 4, 48


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    if not len(x):
        return b""
    planes = x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def grid(count: np.ndarray) -> np.ndarray:
    return np.rint(GRID * np.log2(count + 1.0)).astype(np.uint8)


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1.0).astype(np.int64), BUCKETS - 1)


CHUNKS = "chunk long, tokens long, docs binary, known binary, folds binary, lengths binary, vocabulary binary, places binary, sequence binary"


def growth(docs: DataFrame) -> float:
    """How many times their least size chunks and ranges have."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return min(float(GROWTH), max(1.0, (size / GROWS_FROM) ** 0.5))


def chunks(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """A row per chunk: its documents, and their tokens as ranks in the chunk's own vocabulary."""

    def close(task: int, number: int, ids: list, lengths: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        token = np.concatenate(parts)
        vocabulary, at, count = np.unique(token, return_inverse=True, return_counts=True)
        by_count = np.argsort(-count, kind="stable")
        rank = np.empty(len(by_count), np.uint32)
        rank[by_count] = np.arange(len(by_count), dtype=np.uint32)
        folds = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids], np.uint8)
        row = [
            (task << 24) + number, len(token), pack(np.array([i or 0 for i in ids], "<i8")), pack(np.array([i is not None for i in ids], np.uint8)),
            pack(folds), pack(np.array(lengths, "<u4")), pack_sorted(vocabulary), pack(by_count.astype("<u4")), pack(rank[at]),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        lengths: list = []
        parts: list[np.ndarray] = []
        for batch in lean(batches):
            data, offsets = flat(batch.column(1))
            opens = True
            for part, at, i, j, ends in split(data, offsets, STEP):
                part = LOWER[part]
                start, end, owner = words(part, at)
                count = np.bincount(owner, minlength=j - i) + ends
                token = np.full(int(count.sum()), END)
                is_word = np.ones(len(token), bool)
                if ends:
                    is_word[np.cumsum(count) - 1] = False
                token[is_word] = Hasher(part).spans(start, end)
                if opens:
                    ids += batch.column(0).slice(i, j - i).to_pylist()
                    lengths += count.tolist()
                else:
                    lengths[-1] += int(count[0])
                parts.append(token)
                size, opens = size + len(token), ends
                if ends and size >= most:
                    yield close(task, number, ids, lengths, parts)
                    number, size, ids, lengths, parts = number + 1, 0, [], [], []
        if ids:
            yield close(task, number, ids, lengths, parts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNKS)


class Chunk:
    """A stored chunk, read back."""

    def __init__(self, row: dict):
        self.docs = unpack(row["docs"], "<i8")
        self.known = unpack(row["known"], "u1").astype(bool)
        self.folds = unpack(row["folds"], "u1")
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.vocabulary = unpack_sorted(row["vocabulary"])
        self.token = unpack(row["places"], "<u4")[unpack(row["sequence"], "<u4")].astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.end = int(self.token[self.first[0] + self.lengths[0] - 1])
        self.previous = np.r_[self.end, self.token[:-1]]
        self.previous[self.first] = self.end
        self.fold = np.repeat(self.folds, self.lengths)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        h = self.vocabulary
        return np.unique(mix(h[self.previous] * np.uint64(3) + h[self.token]), return_inverse=True)

    def counts(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(at[self.fold != HELD_OUT], minlength=n), np.bincount(at[self.fold == DELETED], minlength=n)


REQUESTS = "range int, chunk long, hashes binary, counts binary, deleted binary, context binary, word binary"
_CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


def _requests(chunk: int, hashes: np.ndarray, count: np.ndarray, deleted: np.ndarray, ranges: int, more: tuple[np.ndarray, ...] = ()) -> pa.RecordBatch:
    """A chunk's sorted hashes and counts, cut by ranges; ``more`` goes along for entries with deleted counts."""
    to = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(to, np.arange(ranges + 1))
    rows = []
    for r in np.flatnonzero(np.diff(cut)):
        s = slice(cut[r], cut[r + 1])
        some = deleted[s] > 0
        rows.append((int(r), chunk, pack_sorted(hashes[s]), pack(count[s].astype("<u4")), pack(deleted[s].astype("<u4")), *(pack(x[s][some]) for x in more or (np.zeros(len(hashes), np.uint8),) * 2)))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in REQUESTS.split(", ")])


ANSWERS = "chunk long, range int, counts binary, deleted binary, total long, distinct long, context array<int>, bigram array<int>, word array<int>, held array<long>"


def _totals(requests: DataFrame, ranges: int, deleted_too: bool, histogram: bool) -> DataFrame:
    """Adds up each range over all chunks and answers each chunk; one more row per range has its totals (chunk -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(lean(batches), ["range"]):
            at = borders(t, ["range"])
            for k in range(len(at) - 1):
                rows = t.slice(at[k], at[k + 1] - at[k]).to_pylist()
                hashes = [unpack_sorted(r["hashes"]) for r in rows]
                own = [unpack(r["counts"], "<u4").astype(np.int64) for r in rows]
                gone = [unpack(r["deleted"], "<u4").astype(np.int64) for r in rows]
                ends = np.cumsum([0, *map(len, hashes)])
                unique, to = np.unique(np.concatenate(hashes), return_inverse=True)
                n = len(unique)
                del hashes, unique
                # Counts are far below 2**53, so the sums are exact.
                count = np.bincount(to, np.concatenate(own), n).astype(np.int64)
                deleted = np.bincount(to, np.concatenate(gone), n).astype(np.int64)
                del own
                grids: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 4
                if histogram:
                    some = [g > 0 for g in gone]
                    entry = to[np.concatenate(some)]
                    v = np.concatenate([unpack(r["context"], "u1") for r in rows])
                    w = np.concatenate([unpack(r["word"], "u1") for r in rows])
                    key = (v.astype(np.int64) << 16) | (grid(count[entry] - deleted[entry]).astype(np.int64) << 8) | w
                    key, place = np.unique(key, return_inverse=True)
                    held = np.bincount(place, np.concatenate(gone)[np.concatenate(some)], len(key)).astype(np.int64)
                    grids = (key >> 16, (key >> 8) & 255, key & 255, held)
                answers = [
                    (r["chunk"], r["range"], pack(count[to[a:b]].astype("<u8")), pack(deleted[to[a:b]].astype("<u8")) if deleted_too else b"", 0, 0, [], [], [], [])
                    for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)
                ]
                answers.append((-1, rows[0]["range"], b"", b"", int(count.sum()), int((count > 0).sum()), *(x.tolist() for x in grids)))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, x) for c, x in zip(zip(*answers, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ANSWERS.split(", ")]
                )

    return requests.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(run, ANSWERS)


def _with_answers(stored: DataFrame, number: int, *answers: DataFrame) -> DataFrame:
    """Chunks and the answers to them, those of a chunk in one partition in order: kind, then range."""
    empty = lambda names: [F.lit(None).cast("binary").alias(c) for c in names]
    rows = stored.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("range"), *_CHUNK_COLUMNS[2:], *empty(["counts", "deleted"]))
    for kind, a in enumerate(answers, 1):
        rows = rows.unionByName(a.filter("chunk >= 0").select("chunk", F.lit(kind).alias("kind"), "range", *empty(_CHUNK_COLUMNS[2:]), "counts", "deleted"))
    return rows.repartition(number, "chunk").sortWithinPartitions("chunk", "kind", "range")


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list[list[dict]]]]:
    for t in runs(lean(batches), ["chunk"]):
        at = borders(t, ["chunk"])
        for k in range(len(at) - 1):
            rows = t.slice(at[k], at[k + 1] - at[k]).to_pylist()
            yield rows[0]["chunk"], Chunk(rows[0]), [[r for r in rows if r["kind"] == kind] for kind in (1, 2)]


def _joined(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([unpack(r[name], "<u8") for r in rows]).astype(np.int64)


def learn_mixture(histogram: list[tuple[int, int, int, int]], total: int, distinct: int, rounds: int = 60, prior: float = 2.0) -> np.ndarray:
    """Mixture weights per context bucket by EM; each bucket is smoothed with ``prior`` counts of the overall mixture."""
    mix3 = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    if not histogram or not total:
        mix3[0] = [0.0, 2 / 3, 1 / 3]
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1)) if not total else mix3
    v, b, w, held = (np.array(x, np.float64) for x in zip(*histogram, strict=True))
    count = lambda g: np.exp2(g / GRID) - 1.0
    at = np.minimum((v / GRID).astype(np.int64), BUCKETS - 1)
    p = np.stack([np.divide(count(b), count(v), out=np.zeros(len(v)), where=v > 0).clip(max=1.0), count(w) / total, np.full(len(v), 1.0 / (distinct + 1))], 1)
    for _ in range(rounds):
        part = mix3[at] * p
        part *= (held / part.sum(1))[:, None]
        overall = part.sum(0) / part.sum()
        mix3 = np.stack([np.bincount(at, part[:, k], BUCKETS) for k in range(3)], 1) + prior * overall
        mix3 /= mix3.sum(1, keepdims=True)
    # A little of each estimate keeps all words possible everywhere.
    mix3 = np.maximum(mix3, 1e-6)
    # A context that was never seen has no bigrams: the others share its probability.
    mix3[0, 0] = 0.0
    return mix3 / mix3.sum(1, keepdims=True)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    larger = growth(docs)
    stored = staged(chunks(docs, int(CHUNK * larger)), "chunks", "uncompressed")
    tokens, number = stored.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    ranges, number = max(1, -(-(tokens or 0) // int(RANGE_TOKENS * larger))), max(1, number)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                yield _requests(row["chunk"], c.vocabulary, *c.counts(c.token, len(c.vocabulary)), ranges)

    unigrams = staged(_totals(stored.mapInArrow(ask_words, REQUESTS), ranges, True, False), "unigrams", "uncompressed")
    total, distinct = unigrams.filter("chunk = -1").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = total or 0, distinct or 0

    def ask_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c, (words_told, _) in _each_chunk(batches):
            left = grid(_joined(words_told, "counts") - _joined(words_told, "deleted"))
            hashes, at = c.bigrams()
            sample = np.empty(len(hashes), np.int64)
            sample[at] = np.arange(len(at))
            yield _requests(chunk, hashes, *c.counts(at, len(hashes)), ranges, (left[c.previous[sample]], left[c.token[sample]]))

    bigrams = staged(_totals(_with_answers(stored, number, unigrams).mapInArrow(ask_bigrams, REQUESTS), ranges, False, True), "bigrams", "uncompressed")
    cells = bigrams.filter("chunk = -1").select(F.explode(F.arrays_zip("context", "bigram", "word", "held")).alias("c"))
    cells = cells.groupBy("c.context", "c.bigram", "c.word").agg(F.sum("c.held").alias("held"))
    # At most one row per cell of the grid.
    mixture = learn_mixture([tuple(r) for r in cells.collect()], total, distinct)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, (words_told, bigrams_told) in _each_chunk(batches):
            count = _joined(words_told, "counts")
            _, at = c.bigrams()
            together = _joined(bigrams_told, "counts")[at]
            base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
            before = count[c.previous]
            m = mixture[bucket(before)]
            p = m[:, 0] * together / np.maximum(before, 1) + m[:, 1] * (count[c.token] / max(total, 1)) + m[:, 2] / (distinct + 1)
            n = len(c.docs)
            per = lambda x: np.add.reduceat(x, c.first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.docs, mask=~c.known), pa.array(c.folds == HELD_OUT), pa.array(c.lengths), pa.array(per((count[c.token] > 0).astype(np.int64))),
                    pa.array(np.full(n, total, np.int64)), pa.array(per(base[c.token])), pa.array(per(np.log10(p))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(stored, number, unigrams, bigrams).mapInArrow(tell, kinds)

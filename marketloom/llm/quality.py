"""Quality classifier: supervised subword embeddings.

A document is one weighted average of hashed vectors: of its character n-grams of two
sizes, words, word pairs, and word triples of which only the pattern of equal words
is kept, by which repetition generalises. Each of these families has the same weight
in the average, whatever the number of its n-grams. A linear layer and softmax give
the classes. Vectors and layer are trained by numpy stochastic gradient descent with
per-vector adaptive steps on the driver, over at most ``bound`` labelled documents.

As the network is linear up to the softmax, scoring needs one number a bucket:
the table of ``BUCKETS`` of them is broadcast, and every whole text is scored
where it lies, a very long one part by part. Null and empty texts score by the bias alone. Repeated rows score
alike; an empty table gives no rows; without labels of both classes the score is
the smoothed share of class 1. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketloom.llm.labelled import training_rows
from marketloom.llm.textops import LOWER, Hasher, flat, lean, segments, spaced, words

BUCKETS = 1 << 17
GRAMS = (3, 5)
#: Bytes of text that are hashed together; a longer text is taken in parts of this size.
STEP = 500_000
_K = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return (((h + np.uint64(family)) * _K) >> np.uint64(47)).astype(np.int64)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of character n-grams in order of text, and how many each text has; one size after the other."""
    hasher = Hasher(data)
    # Characters begin at bytes that continue no other.
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(begin, offsets)
    length = np.diff(first)
    room = np.repeat(first[1:], length) - np.arange(len(begin))
    ends = np.append(begin, len(data))
    for k in GRAMS:
        at = np.flatnonzero(room >= k)
        yield _bucket(hasher.spans(begin[at], ends[at + k]), k), np.maximum(length - k + 1, 0)


def _word_features(h: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of words, pairs and the triples' patterns."""
    count = np.bincount(owner, minlength=n)
    yield _bucket(h, 11), count
    same = owner[1:] == owner[:-1]
    yield _bucket(h[:-1] * np.uint64(3) + h[1:], 12)[same], np.maximum(count - 1, 0)
    last = owner[2:] == owner[:-2]
    a, b, c = h[:-2], h[1:-1], h[2:]
    shape = (a == b).astype(np.uint64) + 2 * (b == c).astype(np.uint64) + 4 * (a == c).astype(np.uint64)
    yield _bucket(shape, 13)[last], np.maximum(count - 2, 0)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: buckets of its n-grams in order of text, and how many each text has."""
    yield from _grams(data, offsets)
    start, end, owner = words(data, offsets)
    yield from _word_features(Hasher(data).spans(start, end), owner, len(offsets) - 1)


def _long_features(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Family numbers and buckets of one very long text, part by part; together they are those of ``features``."""
    for at in range(0, len(data), STEP):
        # Five characters beyond the part have at most 20 bytes; n-grams that begin in the part count.
        part = LOWER[data[at : at + STEP + 24]]
        hasher, begin = Hasher(part), np.flatnonzero((part & 0xC0) != 0x80)
        ends = np.append(begin, len(part)) if at + len(part) == len(data) else begin
        for family, k in enumerate(GRAMS):
            own = np.arange(min(int(np.searchsorted(begin, STEP)), max(len(ends) - k, 0)))
            yield family, _bucket(hasher.spans(begin[own], ends[own + k]), k)
    before = np.zeros(0, np.uint64)
    for a, b in spaced(data, STEP):
        part = LOWER[data[a:b]]
        start, end, _ = words(part, np.array([0, b - a]))
        h = np.append(before, Hasher(part).spans(start, end))
        # The last two words were counted as words, and as a pair, with the part before.
        seen = (len(before), max(len(before) - 1, 0), 0)
        for k, (bucket, _) in enumerate(_word_features(h, np.zeros(len(h), np.int64), 1)):
            yield len(GRAMS) + k, bucket[seen[k] :]
        before = h[-2:]


def document_vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their weights in its average."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    found = [bucket for bucket, _ in features(data, np.array([0, len(data)])) if len(bucket)]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    weight = np.concatenate([np.full(len(b), 1.0 / (len(found) * len(b))) for b in found])
    index, at = np.unique(np.concatenate(found), return_inverse=True)
    return index.astype(np.int32), np.bincount(at, weight, len(index)).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 12, rate: float = 2.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """The score table and bias, so that P(class 1) is the logistic of bias + sum of weighted entries."""
    labels = np.array([r[2] for r in rows])
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    bias = np.array([0.0, prior], np.float32)
    seen, seen_layer = np.full(BUCKETS, 1e-8, np.float32), 1e-3
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, weight, label = rows[k]
            if not len(index):
                continue
            own = vectors[index]
            x = weight @ own
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = layer @ p
            step_layer = np.outer(x, p)
            seen_layer += float((step_layer**2).sum())
            layer -= rate / np.sqrt(seen_layer) * step_layer
            bias -= 0.05 * p
            size = weight * weight * float(back @ back)
            seen[index] += size
            vectors[index] = own - (rate * weight / np.sqrt(seen[index]))[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    total, families = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for i, j in segments(offsets, STEP):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) > STEP and j - i == 1:
            sums, counts = np.zeros(len(GRAMS) + 3), np.zeros(len(GRAMS) + 3)
            for family, bucket in _long_features(part):
                sums[family] += table[bucket].sum(dtype=np.float64)
                counts[family] += len(bucket)
            total[i], families[i] = (sums[counts > 0] / counts[counts > 0]).sum(), (counts > 0).sum()
            continue
        for bucket, count in features(LOWER[part], at):
            some = np.flatnonzero(count)
            if len(some):
                first = (np.cumsum(count) - count)[some]
                total[i + some] += np.add.reduceat(table[bucket], first, dtype=np.float64) / count[some]
                families[i + some] += 1
    return 1.0 / (1.0 + np.exp(-(bias + total / np.maximum(families, 1))))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = 2500) -> tuple[np.ndarray, float]:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_vector(t.as_py().encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([w.tobytes() for _, w in made], pa.binary())],
                names=["doc_id", "label", "index", "weight"],
            )

    rows = training_rows(docs, labels, target, bound).mapInArrow(vectors, "doc_id long, label int, index binary, weight binary").toArrow().sort_by("doc_id")
    made = zip(rows["index"], rows["weight"], rows["label"].to_pylist(), strict=True)
    return train([(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float32), y) for i, w, y in made])


def score(docs: DataFrame, table: np.ndarray, bias: float, name: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 of every whole text, in a column ``name``, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            kept = [c for c in batch.schema.names if c != name]
            made = pa.array(score_texts(data, offsets, shared.value, bias))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, name])

    docs = docs.drop(name)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = 2500, name: str = "score") -> DataFrame:
    return score(docs, *fit(docs, labels, target, bound), name)

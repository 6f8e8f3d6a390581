"""Toxicity by multiple-instance learning.

A document is a bag of sentences, of which labels say nothing. A sentence scores
by a logistic model over hashed words and word beginnings; the document by
noisy-or: one minus the product of the sentences' complements. Training
maximises the likelihood of document labels through the noisy-or, by full-batch
numpy gradient steps (Adam) on the driver over at most ``bound`` labelled
documents, so the model learns which sentences offend; they are then located.

Scores of null and empty texts are 0 (no sentence). A very long text is scored in
windows that begin with a sentence. Repeated rows score alike;
an empty table gives no rows; with no positive label every score is near 0. Only
doc_id and text are read for scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketloom.llm.labelled import training_rows
from marketloom.llm.textops import LOWER, Hasher, flat, lean, segments, words

BUCKETS = 1 << 18
#: Word beginnings of so many bytes are features, besides the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: A sentence ends after these bytes at a word's end, at a newline, or after LONGEST words.
LONGEST = 32
#: Bytes of text that are scored together; a longer text is taken in windows of this size.
STEP = 500_000
#: Features that training adds up at once; bounds the driver's scratch arrays.
BLOCK = 1 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
#: ASCII punctuation parts words; bytes of letters beyond ASCII don't.
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = [not chr(i).isalnum() for i in range(128)]
_K = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return (((h + np.uint64(family)) * _K) >> np.uint64(46)).astype(np.int32)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (start, end, sentence number) and, per sentence, its first word and text number."""
    start, end, owner = words(data, offsets, _BREAKS)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    gaps = np.cumsum(np.r_[0, _ENDS[data] | (data == 10)])
    new = np.r_[True, (gaps[start[1:]] > gaps[end[:-1]]) | (owner[1:] != owner[:-1])]
    place = np.arange(len(start))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % LONGEST == 0
    return start, end, np.cumsum(new) - 1, np.flatnonzero(new), owner[new]


def buckets(data: np.ndarray, start: np.ndarray, end: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """A row per word: the buckets of its features; bucket 0, which has no weight, for a word said again at once."""
    hasher = Hasher(data)
    whole = hasher.spans(start, end)
    out = [_bucket(whole, 0)]
    for k in BEGINNINGS:
        out.append(_bucket(hasher.spans(start, np.minimum(start + k, end)), k))
    out = np.stack(out, 1)
    out[1:][(whole[1:] == whole[:-1]) & (sentence[1:] == sentence[:-1])] = 0
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 300, rate: float = 0.1, lasso: float = 0.3, rare: int = 3, settle: int = 80) -> tuple[np.ndarray, float]:
    """Bucket weights and bias from (features by word, sentence of each word, label) of documents.

    Features in fewer than ``rare`` documents keep weight 0; so do, by an L1
    penalty of ``lasso`` documents' pull, those that explain few labels. Weights
    aren't negative: no harmless word excuses an offending one beside it. After
    ``settle`` steps features of weight 0 are left out.
    """
    weights, bias = np.zeros(BUCKETS), -6.0
    docs = [d for d in docs if len(d[1])]
    label = np.array([d[2] for d in docs], float)
    if not len(docs) or not label.any():
        return weights.astype(np.float32), -20.0
    count = np.zeros(BUCKETS, np.int32)
    for f, _, _ in docs:
        count[np.unique(f)] += 1
    keep = count >= rare
    keep[0] = False
    doc = np.repeat(np.arange(len(docs)), [d[1][-1] + 1 for d in docs])
    used = np.flatnonzero(keep)
    renamed = np.cumsum(keep, dtype=np.int32) - 1
    total = sum(int(np.count_nonzero(keep[f])) for f, _, _ in docs)
    index, sentence, at, n = np.empty(total, np.int32), np.empty(total, np.int32), 0, 0
    for f, s, _ in docs:
        rows, columns = np.nonzero(keep[f])
        here = slice(at, at + len(rows))
        index[here], sentence[here] = renamed[f[rows, columns]], s[rows] + n
        at, n = at + len(rows), n + int(s[-1]) + 1
    size = len(docs)
    del docs
    w, b, penalty = np.zeros(len(used)), bias, lasso / size
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.full(n, b)
        for i in range(0, len(index), BLOCK):
            z += np.bincount(sentence[i : i + BLOCK], w[index[i : i + BLOCK]], n)
        p = 1 / (1 + np.exp(-z))
        total = np.maximum(np.bincount(doc, _softplus(z), size), 1e-9)
        pull = np.where(label > 0, -1.0 / np.expm1(np.minimum(total, 50)), 1.0)
        back = p * pull[doc] / size
        grad = np.zeros(len(used))
        for i in range(0, len(index), BLOCK):
            grad += np.bincount(index[i : i + BLOCK], back[sentence[i : i + BLOCK]], len(used))
        grad = np.append(grad + penalty, back.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-7)
        after = w - step[:-1]
        w, b = np.maximum(after, 0.0), b - step[-1]
        if t == settle:
            live = w != 0
            index, left = (np.cumsum(live, dtype=np.int32) - 1)[index], live[index]
            index, sentence, used, w = index[left], sentence[left], used[live], w[live]
            mean, square = mean[np.append(live, True)], square[np.append(live, True)]
    weights[used] = w
    return weights.astype(np.float32), float(b)


def _located(part: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per sentence: score before the logistic, text number, and first and last byte; and where the part's last sentence begins.

    Of a part that is cut off, the last sentence is left out.
    """
    start, end, sentence, first, owner = sentences(part, offsets)
    if cut:
        if len(first) < 2:
            return np.zeros(0), owner[:0], np.zeros((0, 2), np.int64), 0
        rest = int(start[first[-1]])
        start, end, sentence, first, owner = start[: first[-1]], end[: first[-1]], sentence[: first[-1]], first[:-1], owner[:-1]
    else:
        rest = len(part)
    if not len(start):
        return np.zeros(0), owner, np.zeros((0, 2), np.int64), rest
    z = np.add.reduceat(weights[buckets(part, start, end, sentence)].sum(1, dtype=np.float64), first) + bias
    last = np.r_[first[1:], len(start)] - 1
    return z, owner, np.stack([start[first], end[last]], 1), rest


def _windows(data: np.ndarray, weights: np.ndarray, bias: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``_located`` over one very long text, in windows that begin with a sentence."""
    at, size = 0, STEP
    while at < len(data):
        part = LOWER[data[at : at + size]]
        z, owner, span, rest = _located(part, np.array([0, len(part)]), weights, bias, at + size < len(data))
        if rest:
            yield at, part, z, owner, span
            at, size = at + rest, STEP
        else:
            size *= 2


def score_texts(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores, and the offending sentences (start and end in code points, score) of each text."""
    n = len(offsets) - 1
    total, spans = np.zeros(n), [[] for _ in range(n)]
    for i, j in segments(offsets, STEP):
        whole, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j - i == 1 and len(whole) > STEP:
            found, alone = _windows(whole, weights, bias), True
        else:
            part = LOWER[whole]
            found, alone = [(0, part, *_located(part, at, weights, bias, False)[:3])], False
        gone, points = 0, 0  # bytes of a long text before the window, and code points in them
        for begin, part, z, owner, span in found:
            total[i:j] += np.bincount(owner, _softplus(z), j - i)
            bad = np.flatnonzero(z >= 0)
            if alone:
                points, gone = points + int(((whole[gone:begin] & 0xC0) != 0x80).sum()), begin
            if len(bad):
                begins = np.cumsum(np.r_[0, (part & 0xC0) != 0x80])
                base = begins[at] - points if not alone else np.array([-points])
                for s in bad:
                    first = base[owner[s]]
                    spans[i + owner[s]].append((int(begins[span[s, 0]] - first), int(begins[span[s, 1]] - first), float(1 / (1 + np.exp(-z[s])))))
    return -np.expm1(-total), spans


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = 4000) -> tuple[np.ndarray, float]:
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):
                data = LOWER[np.frombuffer(text.as_py().encode(), np.uint8)]
                start, end, sentence, _, _ = sentences(data, np.array([0, len(data)]))
                made.append((buckets(data, start, end, sentence) if len(start) else np.zeros((0, 0), np.int32), sentence.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())],
                names=["doc_id", "label", "features", "sentence"],
            )

    rows = training_rows(docs, labels, target, bound).mapInArrow(bags, "doc_id long, label int, features binary, sentence binary").toArrow().sort_by("doc_id")
    width = 1 + len(BEGINNINGS)
    made = zip(rows["features"], rows["sentence"], rows["label"].to_pylist(), strict=True)
    made = [(np.frombuffer(f.as_buffer(), np.int32).reshape(-1, width), np.frombuffer(s.as_buffer(), np.int32), y) for f, s, y in made]
    del rows
    return train(made)


def score(docs: DataFrame, weights: np.ndarray, bias: float, name: str = "score", located: str = "offending") -> DataFrame:
    """``docs`` with the probability that a whole text is toxic, and its offending sentences; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            scores, spans = score_texts(data, offsets, shared.value, bias)
            kept = [c for c in batch.schema.names if c not in (name, located)]
            rows = [[{"start": a, "end": b, "score": s} for a, b, s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores), pa.array(rows, kind)], names=[*kept, name, located])

    docs = docs.drop(name, located)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(located, SPANS)]))


def detect(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = 4000, name: str = "score", located: str = "offending") -> DataFrame:
    return score(docs, *fit(docs, labels, target, bound), name, located)

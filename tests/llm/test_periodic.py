"""Periodic runs against all periods and stretches tried one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marketloom.llm import periodic, queries, textops

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """Every stretch of every period, kept if no smaller period fits it."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            start, end = i, j + p
            if end - start >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(start, end - q)) for q in range(1, p)):
                out.append((start, end - start, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if planted and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def messy(rng, n):
    """Words of a small alphabet with repeats of repeats in them."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        elif kind < 0.7:
            out += [rng.choice("ab") for _ in range(rng.randint(1, 5))] * rng.randint(2, 7)
        else:
            unit = [rng.choice("ab") for _ in range(rng.randint(1, 3))] * rng.randint(2, 5) + [rng.choice("abc")]
            out += unit * rng.randint(2, 6)
    return out[:n]


@pytest.mark.parametrize("single, probes", [(48, 200_000), (2, 7), (1, 64)])
def test_all_runs_are_found(monkeypatch, single, probes):
    monkeypatch.setattr(periodic, "SINGLE", single)
    monkeypatch.setattr(periodic, "PROBES", probes)
    monkeypatch.setattr(periodic, "CHUNK", 2)
    rng = random.Random(single)
    texts = [messy(rng, rng.randint(0, 120)) for _ in range(150)] + [["x"] * 300, ["a", "b"] * 120 + ["a"], []]
    data = " ".join(" ".join(t) for t in texts).encode()
    sizes = [len(" ".join(t).encode()) for t in texts]
    flat = np.frombuffer("".join(" ".join(t) for t in texts).encode(), np.uint8)
    assert len(data) >= len(flat)
    offsets = np.append(0, np.cumsum(sizes))
    start, end, owner = textops.words(flat, offsets)
    found, size = periodic.runs_of(textops.Hasher(flat).spans(start, end), owner, len(texts))
    assert size.tolist() == [len(t) for t in texts]
    want = [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]
    assert [tuple(r) for r in found.tolist()] == want
    assert len(want) > 100


def test_wide_runs_are_not_extended_again(monkeypatch):
    tried = []
    extent = periodic._extent
    monkeypatch.setattr(periodic, "_extent", lambda code, at, p: tried.append(p) or extent(code, at, p))
    monkeypatch.setattr(periodic._Found, "BUCKET", 4)
    code = np.r_[np.tile(np.arange(3, dtype=np.uint64), 2000), np.full(700, 7, np.uint64)]
    found, _ = periodic.runs_of(code, np.zeros(len(code), np.int64), 1)
    assert found.tolist() == [[0, 0, 6000, 3], [0, 6000, 700, 1]]
    assert len(tried) < 20


def test_query_equals_the_plain_version(spark, small):
    got = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len(WORD.findall(d["text"] or "")) < 1500]
    assert len(short) > 150 and len(got) == len(docs)
    for d in short:
        assert got[d["doc_id"]] == plain_digest(d["doc_id"], d["text"])
    assert sum(r[1] > 0 for r in got.values()) > 20


def test_odd_documents(spark):
    rows = [
        (1, None, 7), (2, "", 7), (None, "a a a a a a b", 7), (4, " \t\n ", 7), (5, "a b " * 4, 7), (5, "a b " * 4, 7),
        (6, "é é é é " * 3, 7), (7, "word", 7), (8, "x y z " * 40_000 + "x", 7), (9, "w" * 5000 + " ", 7), (10, ("v" * 300 + " ") * 9, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=str)
    assert got == sorted(
        [
            (1, [], ""), (2, [], ""), (None, [(0, 6, 1)], "a b"), (4, [], ""), (5, [(0, 8, 2)], "a b"), (5, [(0, 8, 2)], "a b"),
            (6, [(0, 6, 1)], "é é"), (7, [], "word"), (8, [(0, 120_001, 3)], "x y z"), (9, [], "w" * 5000), (10, [(0, 9, 1)], "v" * 300),
        ],
        key=str,
    )
    digests = periodic.digest(docs).collect()
    assert sorted(map(str, [tuple(r) for r in digests if r["doc_id"] != 8])) == sorted(str(plain_digest(i, t, False)) for i, t, _ in rows if i != 8)
    assert periodic.digest(docs.limit(0)).count() == 0


def test_tails_that_repeat_are_planted(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(400)] + [(None, "a b c d e f g"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in periodic.digest(queries.repeated_tails(docs)).collect()]
    assert sorted(map(str, got)) == sorted(str(plain_digest(i, t)) for i, t in rows)

"""Texts that break weak hashes, and texts of tens of megabytes."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

from conftest import ROOT
from marketloom.llm import interpolation, jaccard, packing, quality, textops, toxicity
from marketloom.llm.storage import staged

DOCS = "doc_id long, text string"


def regular(n, a="a", b="b"):
    """The two complementary Thue-Morse words of ``n`` letters, on which polynomials modulo 2^64 collide."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_spans_of_any_length_are_told_apart():
    for n in (256, 512, 1024, 4096):
        x, y = regular(n)
        data = np.frombuffer((x + y).encode(), np.uint8)
        one, two = textops.Hasher(data).spans(np.array([0, n]), np.array([n, 2 * n]))
        assert one != two


def test_spans_over_several_blocks(monkeypatch):
    text = np.frombuffer(("ab c" * 300 + " " + "xyz" * 200 + " ") .encode() * 3, np.uint8)
    start, end, _ = textops.words(text, np.array([0, len(text)]))
    want = textops.Hasher(text).spans(start, end)
    monkeypatch.setattr(textops, "BLOCK", 64)
    assert (textops.Hasher(text).spans(start, end) == want).all()
    assert len(np.unique(want)) == len({text[a:b].tobytes() for a, b in zip(start, end, strict=True)})


def test_packing_gives_unlike_words_their_own_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    x, y = regular(1024)
    texts = [x, y, f"{y} {x} ab", regular(4096)[1]]
    encoder = packing.WordEncoder(path)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_words_that_share_a_hash_are_encoded_by_themselves(monkeypatch):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    spans = textops.Hasher.spans
    monkeypatch.setattr(packing.Hasher, "spans", lambda self, a, b: spans(self, a, b) % np.uint64(7))
    encoder._forget()
    for t in ("the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs the fox"):
        data = np.frombuffer(t.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_jaccard_keeps_unlike_documents_apart(spark):
    x, y = regular(1024)
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} b c d e f g"), (4, f"{y} b c d e f g")], DOCS)
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 0, True)]
    assert jaccard.drop_near_duplicates(docs).count() == 4


def test_language_model_counts_unlike_words(spark):
    x, y = regular(2048)
    # Ids 0 to 9 by crc32: enough rows that some train.
    rows = [(i, f"{x} a") for i in range(40)] + [(100 + i, f"{y} {y} a") for i in range(40)]
    got = {r["doc_id"]: r for r in interpolation.score(spark.createDataFrame(rows, DOCS)).collect()}
    ones, twos = {got[i]["base_score"] for i in range(40)}, {got[100 + i]["base_score"] for i in range(40)}
    train = [i for i, _ in rows if not got[i]["held_out"]]
    n, a = got[0]["train_tokens"], sum(i < 100 for i in train)
    assert n == 3 * a + 4 * (len(train) - a)
    log = lambda c: np.log10((c + 0.1) / (n + 0.1 * 5))  # noqa: E731  words x, y, a and the end
    assert list(ones) == pytest.approx([log(a) + 2 * log(len(train))], rel=1e-12)
    assert list(twos) == pytest.approx([2 * log(2 * (len(train) - a)) + 2 * log(len(train))], rel=1e-12)


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 11))) + str(rng.choice(["", "é", ".", "!\n", ""])) for _ in range(2000)]
    return " ".join(rng.choice(words, n).tolist())


def test_parts_of_a_long_text_score_as_the_whole(monkeypatch):
    text = prose(30_000) + " " + "q" * 9000 + " tail. end"
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    rng = np.random.default_rng(5)
    table = rng.normal(size=quality.BUCKETS).astype(np.float32)
    weights = np.maximum(rng.normal(size=toxicity.BUCKETS), 0).astype(np.float32) / 10
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))

    def told():
        scores, spans = toxicity.score_texts(data, offsets, weights, -3.2)
        return quality.score_texts(data, offsets, table, 0.1), scores, spans, jaccard.shingle_sets(data, offsets, 5)[0], encoder.encode(data, offsets)[0]

    whole = told()
    assert len(whole[2][0]) > 2
    for step in (900, 7777):
        for module in (quality, toxicity, jaccard, packing):
            monkeypatch.setattr(module, "STEP", step)
        parts = told()
        assert np.allclose(parts[0], whole[0], rtol=1e-12) and np.allclose(parts[1], whole[1], rtol=1e-12)
        assert [s[:2] for s in parts[2][0]] == [s[:2] for s in whole[2][0]]
        assert (parts[3] == whole[3]).all() and (parts[4] == whole[4]).all()


def test_language_model_takes_a_long_text_in_parts(spark, monkeypatch):
    rows = [(i, prose(400 + i, i)) for i in range(30)] + [(30, prose(3000, 99)), (31, "z" * 4000), (32, "")]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in interpolation.score(docs).collect())
    monkeypatch.setattr(interpolation, "STEP", 500)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in interpolation.score(docs).collect())
    assert got == want


HUGE = """
import resource, sys
import numpy as np
sys.path.insert(0, {root!r})
from marketloom.llm import {module} as m, textops, quality, toxicity, packing, jaccard, periodic, licences
import public_tokenizers
rng = np.random.default_rng(0)
words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 11))) for _ in range(3000)]
data = np.frombuffer((" ".join(rng.choice(words, 100_000).tolist()) + ". ").encode() * 200, np.uint8)[:60_000_000]
offsets = np.array([0, len(data)])
{call}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1000)
"""
CALLS = {
    "quality": "m.score_texts(data, offsets, np.zeros(m.BUCKETS, np.float32), 0.0)",
    "toxicity": "m.score_texts(data, offsets, np.zeros(m.BUCKETS, np.float32), -4.0)",
    "packing": "m.WordEncoder(public_tokenizers.path('word_bpe_49k.json')).encode(data, offsets)",
    "jaccard": "m.signatures(*m.shingle_sets(data, offsets, 5))",
    "periodic": "s, e, o = textops.words(data, offsets); f, _ = m.runs_of(textops.Hasher(data).spans(s, e), o, 1); textops.joined(data, s, e, o, 1)",
    "licences": "d = textops.LOWER[data]; s, e, o = textops.words(d, offsets, m._BREAKS); m.places(m._automaton(list(m.NOTICES)), list(m.NOTICES), d, s, e, o)",
}


@pytest.mark.parametrize("module", sorted(CALLS))
def test_a_text_of_60_megabytes_stays_under_one_gigabyte(module):
    code = HUGE.format(root=ROOT, module=module, call=CALLS[module])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout) < 1000


def test_one_huge_class_leaves_the_audit_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AUDIT_SHINGLES", 4000)
    rng = np.random.default_rng(1)
    rows = [(0, " ".join(f"h{k}" for k in range(6000)))]
    for g in range(30):
        words = [f"w{g}x{k}" for k in range(60)]
        rows.append((1 + 2 * g, " ".join(words)))
        words[int(rng.integers(0, 60))] = "other"
        rows.append((2 + 2 * g, " ".join([*words, "more"])))
    docs = staged(spark.createDataFrame(rows, DOCS), "docs")
    kept = []
    audited = jaccard._audited
    monkeypatch.setattr(jaccard, "_audited", lambda *a: kept.append(audited(*a)) or kept[-1])
    told = jaccard.near_duplicates(docs, threshold=0.7).collect()
    assert sum(r["n_links"] for r in told) == 60
    assert len(kept[0]) >= 50

"""The n-gram Jaccard join against all pairs, and the corpus pipeline stage by stage."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import jaccard, packing, queries
from marketloom.llm.storage import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep int, key int, h1 int, component int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def classes(docs, threshold=0.8):
    """(doc_id, class_id, n_links, kept) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    root, links, holders = list(range(len(docs))), [0] * len(docs), {}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, own in enumerate(sets):
        for b in set().union(*(holders.get(s, ()) for s in own)):
            both = len(own & sets[b])
            if both >= threshold * (len(own) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
        for s in own:
            holders.setdefault(s, []).append(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, least[top(k)], links[k], i == least[top(k)]) for k, (i, _) in enumerate(docs))


def test_join_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_ngram_jaccard_join(spark, small).collect())) == classes(docs)


def variants(seed, groups):
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([5, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 400)}"
            docs.append((len(docs), " ".join(own)))
    # A chain: each text links with its neighbours only.
    line = [f"c{k}" for k in range(100)]
    return docs + [(len(docs) + k, " ".join(line[2 * k : 2 * k + 40])) for k in range(20)]


def test_join_of_planted_groups(spark, monkeypatch):
    docs = variants(3, 60)
    frame = spark.createDataFrame([(*d, "", "", 0, 0, 0, 0, 0) for d in docs], DOCS)
    want = classes(docs)
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect())) == want
    # The same in small blocks: large groups are compared block by block.
    monkeypatch.setattr(jaccard, "PREFIX_BLOCK", 3)
    monkeypatch.setattr(jaccard, "SET_BLOCK", 4)
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect())) == want


def test_join_edge_rows(spark):
    long = " ".join(f"t{k}" for k in range(20_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, long), (8, long + " end"), (9, "a b c d e f"), (9, "a b c d e f")]
    frame = spark.createDataFrame([(*d, "", "", 0, 0, 0, 0, 0) for d in docs], DOCS)
    got = sorted(map(tuple, jaccard.near_duplicates(frame).collect()))
    assert got == [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 1, True), (5, 4, 1, False), (6, 6, 0, True), (7, 7, 1, True), (8, 7, 1, False), (9, 9, 1, True), (9, 9, 1, True)]
    kept = jaccard.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9]
    assert jaccard.near_duplicates(frame.limit(0)).collect() == []
    some = jaccard.near_duplicates(frame.withColumn("doc_id", frame["doc_id"] * None)).collect()
    assert len(some) == len(docs) and all(r["doc_id"] is None for r in some)


def test_join_with_repeated_and_null_ids(spark):
    a, b = ([f"{p}{k}" for k in range(60)] for p in "ab")
    text = lambda words, last: " ".join([*words, last])
    # One id with two texts, each near another row's; a text whose only row has no id, near two others.
    rows = [(1, text(a, "x")), (1, text(b, "x")), (2, text(a, "y")), (3, text(b, "y")), (4, text("cdefghijklmnopqrstuvwxyz", "x"))]
    rows += [(None, text("cdefghijklmnopqrstuvwxyz", "y")), (5, text("cdefghijklmnopqrstuvwxyz", "z")), (None, "no id one two three"), (None, "no id one two three")]
    frame = spark.createDataFrame([(*d, "", "", 0, 0, 0, 0, 0) for d in rows], DOCS)
    got = sorted(map(tuple, jaccard.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 4, 2, True), (None, 4, 2, False), (5, 4, 2, False), (None, None, 1, True), (None, None, 1, True)], key=repr)
    kept = jaccard.drop_near_duplicates(frame).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([rows[0], rows[1], rows[4], rows[7]], key=repr)


def test_clashing_columns_survive(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 2, 3, 4, 5), (2, "a b c d e f", 2, 3, 4, 5)], "doc_id long, text string, stays int, times int, H1 int, key int")
    assert [tuple(r) for r in jaccard.drop_near_duplicates(frame).collect()] == [(1, "a b c d e f", 2, 3, 4, 5)]


def test_links_at_the_threshold(spark):
    # 300 pairs whose similarity is exactly 0.8: 36 common shingles of 45.
    docs = []
    for g in range(300):
        words = [f"{g}w{k}" for k in range(44)]
        docs += [(2 * g, " ".join(words[:40] + [f"{g}u{k}" for k in range(4)])), (2 * g + 1, " ".join(words[:40] + [f"{g}v{k}" for k in range(5)]))]
    frame = spark.createDataFrame([(*d, "", "", 0, 0, 0, 0, 0) for d in docs], DOCS)
    got = sorted(map(tuple, jaccard.near_duplicates(frame).collect()))
    want = classes(docs)
    assert sum(w[2] for w in want) == 600 and sum(a == b for a, b in zip(got, want, strict=True)) >= 0.995 * len(want)


def test_prefix_is_shortened_until_the_audit_meets_the_target():
    chance = lambda j: np.array([jaccard.expected(np.array(j), d) for d in range(1, jaccard.DEEPEST + 1)])
    depths = [jaccard.matching_depth([(np.ones(jaccard.DEEPEST), chance(j))], 0.8, 0.9999) for j in (0.95, 0.8, 0.5)]
    assert depths[0] == jaccard.DEEPEST and depths[0] > depths[1] > depths[2] >= 1
    # Measured losses count although none are expected.
    lost = np.array([1.0, 1.0, 1.0, 0.9, 0.8, 0.7])
    assert jaccard.matching_depth([(lost, chance(0.95))], 0.8, 0.99) == 3
    assert jaccard.matching_depth([], 0.8, 0.9999) == 5


def test_audit_compares_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AUDIT_ANY", 10_000)
    docs = variants(11, 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    signed = staged(jaccard._signed(frame, 5), "signed")
    reps = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("tries").alias("tries"))
    reps = staged(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    told = jaccard._audited(frame, reps, 0.8, 5)
    links = [w for w in classes(docs) if w[2]]
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    of = {}
    for i, c, *_ in classes(docs):
        of.setdefault(c, set()).add(sets[i])
    assert links and len({s for c in of.values() if len(c) > 1 for s in c}) == len(told)
    assert all(a[0][0] >= a[0][-1] and 0.9 < a[0][0] <= 1 for a in told)


def test_pipeline_stages(spark, small):
    docs = staged(spark.read.parquet(f"{small}/documents.parquet"), "given")
    quality, toxicity, join, pack = (f for _, f in corpus_pipeline.STAGES)
    good = staged(quality(spark, docs, small), "good")
    scores = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, small).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, r in scores.items() if r["predicted"] == 1}
    clean = staged(toxicity(spark, good, small), "clean")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    left = {r["doc_id"] for r in clean.collect()}
    gone = {r["doc_id"] for r in good.collect()} - left
    assert all(labels.get(i) != 0 for i in gone) and sum(labels.get(i) == 1 for i in left) <= 1
    one = staged(join(spark, clean, small), "one")
    want = classes([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == [w[0] for w in want if w[3]]
    assert docs.columns == good.columns == clean.columns == one.columns
    rows = pack(spark, one, small).collect()
    again = packing.token_pieces(one, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, again))
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "piece", "length").collect())) == sorted((r["doc_id"], r["piece"], r["length"]) for r in rows)


def test_pipeline_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.collect() == []


def test_pipeline_keeps_clashing_columns_and_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 60")
    odd = spark.createDataFrame([(900, None, "en", "s", 0), (None, "A text without an id that is long enough to be kept by all stages", "en", "s", 9), (901, "", "en", "s", 0), (901, "", "en", "s", 0)], docs.schema)
    given = docs.unionByName(odd).unionByName(docs.filter("doc_id < 5"))
    more = {c: F.lit(7.5) for c in ("score", "offending", "stays", "times", "_times", "own", "h1", "h2", "key", "class_id", "piece")}
    given = given.withColumns(more)
    kept = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, small), "kept")
        assert kept.columns == given.columns
    rows = kept.collect()
    assert rows and all(r[c] == 7.5 for r in rows for c in more)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and len(rows) > 30
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, small).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}

"""URL filters, both classifiers and language-model scores."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import interpolation, labelled, quality, queries, toxicity, url_filter
from marketloom.llm.textops import Hasher

DOCS = "doc_id long, text string, score double, label int, chunk int, tokens long"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fit = []
    for verdict, rule in queries.URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


def test_url_query_equals_its_sql(spark, medium):
    duck = duckdb.connect()
    for t in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    want = sorted(duck.execute(queries.SQL["op5_url_filters"]).fetchall())
    rows = queries.op5_url_filters(spark, medium)
    assert sorted(map(tuple, rows.collect())) == want and rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    for page, host, path, rule, verdict in want:
        assert (rule, verdict) == rule_of(host, path) or (rule is None and rule_of(host, path)[0] is None)


def test_urls_of_odd_shapes(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q=/en/#f", "http://example.com?x", "http://a.net/es/", "http://net/fr/y", "http://xnet/fr/", "a://b://c/d", "http://É.com/", "http://example.com\n/en/", "http://example.com/en", "http://example.com#/en/"]
    frame = spark.createDataFrame([(i, u, "h", "r", 0, "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, bad int, verdict string")
    for r in url_filter.filter_urls(frame, queries.URL_RULES).collect():
        host, path = split_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule_of(host, path)[0])
    # A repeated row is judged like the first; a very long url is taken whole.
    long = frame.limit(1).withColumn("url", F.lit("http://" + "a" * 100_000 + ".net/fr/"))
    assert [r["rule"] for r in url_filter.filter_urls(long.unionByName(long), queries.URL_RULES).collect()] == ["net/fr/"] * 2
    assert url_filter.filter_urls(frame.limit(0), queries.URL_RULES).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(frame, ()).collect()} == {"allow"}


def reputations(outcomes, domain, suffix):
    """site: (mean, lower bound) by plain loops over (site, bad or None)."""

    def level(nodes, parent, prior):
        told = {}
        for node, (bad, n) in nodes.items():
            a, b = prior[parent(node)]
            told[node] = (bad, n, a / (a + b), a + b)
        many = [(bad, n, m) for bad, n, m, _ in told.values() if n > 1]
        weight = sum((n - 1) * m * (1 - m) for _, n, m in many)
        rho = (sum(n * (bad / n - m) ** 2 for bad, n, m in many) - sum(m * (1 - m) for *_, m in many)) / weight if weight else 1.0
        strength = min(max(1 / max(rho, 1e-9) - 1, 1.0), 100.0)
        out = {}
        for node, (bad, n, m, own) in told.items():
            s = 1 / (1 / (own + 1) + 1 / (strength + 1)) - 1
            out[node] = (bad + m * s, n - bad + (1 - m) * s)
        return out

    def counted_by(key):
        out = {}
        for site, bad in outcomes:
            x, n = out.get(key(site), (0, 0))
            out[key(site)] = (x + (bad or 0), n + (bad is not None))
        return out

    x, n = counted_by(lambda site: 0)[0]
    posterior = level(counted_by(suffix), lambda node: 0, {0: (x + 1, n - x + 1)})
    posterior = level(counted_by(domain), suffix, posterior)
    posterior = level(counted_by(lambda site: site), domain, posterior)
    return {k: (a / (a + b), max(a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), 0.0)) for k, (a, b) in posterior.items()}


def test_reputation_equals_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [("bad.evil.org", 1)] * 60 + [("new.evil.org", None)] + [("a.good.org", 0)] * 200 + [("b.good.org", 1)] + [("fresh.co.uk", None)] + [("x.other.co.uk", 0)] * 40
    rows += [("10.0.0.1", 1), ("10.0.0.2", None), ("q.lonely.xyz", None)] + [(f"h{k}.many.net", int(rng.random() < k / 40)) for k in range(40) for _ in range(20)]
    got = {r["site"]: (r["reputation"], r["lower_bound"]) for r in url_filter.host_reputation(spark.createDataFrame(rows, "site string, bad int")).collect()}
    labels = lambda site, n: site if site[0].isdigit() else ".".join(site.split(".")[-n - site.endswith(".co.uk") :])
    want = reputations(rows, lambda s: labels(s, 2), lambda s: labels(s, 1))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert got["bad.evil.org"][1] > 0.5
    # One bad page of a good domain moves its host; a host without evidence is like its domain, and never certain.
    assert got["a.good.org"][0] < got["b.good.org"][0] and got["new.evil.org"][0] > got["b.good.org"][0]
    assert got["q.lonely.xyz"][1] < 0.5 and got["fresh.co.uk"][1] == 0


def test_reputation_predicts_held_out_outcomes(spark):
    rng = np.random.default_rng(6)
    rate = {f"h{k}.d{k % 30}.{'org' if k % 2 else 'net'}": 0.95 if k % 30 < 6 else 0.05 for k in range(240)}
    hosts = list(rate)
    pages = [(i, f"http://user@{h.upper()}:8080/x/{i}", int(rng.random() < rate[h]), int(rng.random() < 0.5)) for i, h in enumerate(hosts[k] for k in rng.integers(0, 240, 4000))]
    frame = spark.createDataFrame(pages, "page_id long, url string, bad int, told int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(frame, (), F.when(F.col("told") == 1, F.col("bad"))).collect()}
    held = [(got[i]["verdict"] == "block", bad) for i, _, bad, told in pages if not told]
    assert np.mean([b == bad for b, bad in held]) > 0.93 > max(np.mean([bad for _, bad in held]), 1 - np.mean([bad for _, bad in held]))
    # Without labels nothing is blocked.
    assert {r["verdict"] for r in url_filter.filter_urls(frame, ()).collect()} == {"allow"}


def test_sites_domains_and_suffixes(spark):
    hosts = ["a.b.example.co.uk:443", "u:p@www.example.com", "10.0.0.1:80", "[::1]:8080", "localhost", ""]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("site", url_filter.site_of(F.col("host")))
    got = frame.select("site", url_filter.registered_domain(F.col("site")), url_filter.suffix_of(F.col("site"))).collect()
    assert [tuple(r) for r in got] == [("a.b.example.co.uk", "example.co.uk", "co.uk"), ("www.example.com", "example.com", "com"), ("10.0.0.1",) * 3, ("[::1]",) * 3, ("localhost",) * 3, ("",) * 3]
    paths = spark.createDataFrame([(p,) for p in ("/en/12.html", "/en/7/", "/en/x", "", "/9" * 3000)], "path string")
    assert [r[0] for r in paths.select(url_filter.shown_document(F.col("path"))).collect()] == [12, 7, None, None, 9]


def area(score, label):
    score, label = np.asarray(score), np.asarray(label, bool)
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())


@pytest.mark.parametrize("name, target, least", [("op6_toxicity", "toxic", 0.97), ("op8_quality_classifier", "quality", 0.99)])
def test_held_out_accuracy(spark, large, name, target, least):
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, large).collect()}
    assert len(rows) == spark.read.parquet(f"{large}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    labels = [(r["doc_id"], r[target]) for r in spark.read.parquet(f"{large}/labels.parquet").collect() if r[target] is not None]
    held = [(rows[i]["score"], y, rows[i]["predicted"]) for i, y in labels if i in rows and rows[i]["held_out"]]
    assert area([h[0] for h in held], [h[1] for h in held]) >= least
    assert np.mean([h[1] == h[2] for h in held]) >= 0.97


@pytest.mark.parametrize("model, target", [(quality.classify, "quality"), (toxicity.detect, "toxic")])
def test_classifier_edge_rows(spark, model, target):
    docs = spark.createDataFrame([(i, f"good words number {i} stand here." if i % 2 else f"vile slur {i} there. and more.", 0.5, 1, 0, 0) for i in range(60)] + [(100, None, 0.5, 1, 0, 0), (101, "", 0.5, 1, 0, 0), (None, "x", 0.5, 1, 0, 0), (1, "again", 0.5, 1, 0, 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(5, None), (None, 1), (5, 0)], f"doc_id long, {target} int")
    rows = model(docs, labels).collect()
    assert len(rows) == 64 and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (100, 101)}
    assert len(same) == 1
    assert np.mean([r["score"] for r in rows if r["text"] and "vile" in r["text"]]) > np.mean([r["score"] for r in rows if r["text"] and "good" in r["text"]])
    assert model(docs.limit(0), labels).collect() == []
    assert all(math.isfinite(r["score"]) for r in model(docs, labels.limit(0)).collect())


def flat_texts(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)


def test_quality_score_written_out():
    rng = np.random.default_rng(3)
    table, bias = rng.standard_normal(quality.BUCKETS).astype(np.float32), 0.3
    name = lambda s, family: int(quality._bucket(Hasher(np.frombuffer(s.encode(), np.uint8)).spans(np.array([0]), np.array([len(s.encode())])), family)[0])
    word = lambda s: Hasher(np.frombuffer(s.encode(), np.uint8)).spans(np.array([0]), np.array([len(s.encode())]))
    texts = ["", "a", "Éa bé bé éa É", "one two one two three " * 40]
    got = quality.score_texts(*flat_texts(texts), table, bias)
    for text, score in zip(texts, got, strict=True):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = lower.split()
        families = [[name(lower[i : i + k], k) for i in range(len(lower) - k + 1)] for k in quality.GRAMS]
        families.append([name(x, 11) for x in w])
        families.append([int(quality._bucket(word(a) * np.uint64(3) + word(b), 12)[0]) for a, b in zip(w, w[1:], strict=False)])
        families.append([int(quality._bucket(np.array([(a == b) + 2 * (b == c) + 4 * (a == c)], np.uint64), 13)[0]) for a, b, c in zip(w, w[1:], w[2:], strict=False)])
        families = [f for f in families if f]
        z = bias + sum(np.mean([float(table[b]) for b in f]) for f in families) / max(len(families), 1)
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        index, weight = quality.document_vector(text.encode())
        assert bias + float(table[index].astype(float) @ weight) == pytest.approx(z, abs=1e-4)


def test_noisy_or_written_out():
    rng = np.random.default_rng(4)
    weights, bias = np.abs(rng.standard_normal(toxicity.BUCKETS)).astype(np.float32) / 4, -3.0
    weights[0] = 0
    sentences = ["You walked home", "the bread is fresh", "é roofs fell", "grobnak"]
    alone, _ = toxicity.score_texts(*flat_texts(sentences), weights, bias)
    whole, _ = toxicity.score_texts(*flat_texts([". ".join(sentences) + "!", ""]), weights, bias)
    assert whole[0] == pytest.approx(1 - np.prod(1 - alone), abs=1e-9) and whole[1] == 0 and 0 < min(alone)


def test_training_texts_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(labelled, "BYTES", 1000)
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 7 == 0 else 60)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", 100).collect()
    assert 10 <= len(rows) <= 16 and sum(len(r["text"]) for r in rows) <= 1000


def test_offending_sentences_are_located(spark):
    rows = [(i, f"We walked home {i} times. The bread is fresh. " + ("You filthy grobnak! " if i % 3 == 0 else "") + "Rain fell on é roofs.", None, None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    for r in toxicity.detect(docs, labels).collect():
        found = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
        assert found == (["You filthy grobnak"] if r["doc_id"] % 3 == 0 else [])


def counted(docs):
    """Plain deleted interpolation; the mixture is learned on exact counts, as the histogram's grid allows."""
    tokens = {}
    for k, (i, text) in enumerate(docs):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        tokens[k] = ([*re.findall(r"[^\x20\x09-\x0D]+", lower), None], zlib.crc32((str(i) if i is not None else "").encode()) % 10)
    one, two, one_gone, two_gone = Counter(), Counter(), Counter(), Counter()
    for t, fold in tokens.values():
        if fold != 0:
            pairs = list(zip([None, *t[:-1]], t, strict=True))
            one.update(t)
            two.update(pairs)
            if fold == 1:
                one_gone.update(t)
                two_gone.update(pairs)
    total, distinct = sum(one.values()), len(one)
    grid = lambda n: int(np.rint(4 * np.log2(n + 1.0)))
    cells = Counter()
    for (v, w), n in two_gone.items():
        cells[grid(one[v] - one_gone[v]), grid(two[v, w] - n), grid(one[w] - one_gone[w])] += n
    mixture = interpolation.learn_mixture([(*k, n) for k, n in sorted(cells.items())], total, distinct)
    out = []
    for k, (t, fold) in tokens.items():
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        score = 0.0
        for v, w in zip([None, *t[:-1]], t, strict=True):
            m = mixture[min(int(np.log2(one[v] + 1.0)), interpolation.BUCKETS - 1)]
            score += math.log10(m[0] * two[v, w] / max(one[v], 1) + m[1] * one[w] / max(total, 1) + m[2] / (distinct + 1))
        out.append((docs[k][0], fold == 0, len(t), sum(one[w] > 0 for w in t), total, base, score))
    return out


def alike(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[2])
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    for r, w in zip(rows, want, strict=True):
        assert r[:5] == w[:5]
        assert r[5] == pytest.approx(w[5], rel=1e-9) and r[6] == pytest.approx(w[6], rel=1e-4)


def test_language_model_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries.op10_lm_scoring(spark, small).collect()
    alike(rows, counted(docs))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def mixed(histogram, total, distinct, rounds=60, prior=2.0):
    """Expectation-maximisation cell by cell, without arrays."""
    cells = [(min(v / 4, 47) // 1, v, b, w, n) for v, b, w, n in histogram]
    weights = {k: [0.4, 0.4, 0.2] for k in range(48)}
    for _ in range(rounds):
        got = {k: [0.0] * 3 for k in weights}
        for k, v, b, w, n in cells:
            count = lambda g: 2 ** (g / 4) - 1
            p = [min(count(b) / count(v), 1.0) if v else 0.0, count(w) / total, 1 / (distinct + 1)]
            part = [x * y for x, y in zip(weights[k], p, strict=True)]
            for i in range(3):
                got[k][i] += n * part[i] / sum(part)
        overall = [sum(g[i] for g in got.values()) for i in range(3)]
        for k, g in got.items():
            g = [x + prior * o / sum(overall) for x, o in zip(g, overall, strict=True)]
            weights[k] = [x / sum(g) for x in g]
    out = []
    for k in range(48):
        w = [max(x, 1e-6) for x in weights[k]]
        w[0] = 0.0 if k == 0 else w[0]
        out.append([x / sum(w) for x in w])
    return out


def test_mixture_by_plain_expectation_maximisation():
    rng = np.random.default_rng(5)
    histogram = sorted({(int(v), int(min(v, b)), int(w)) for v, b, w in rng.integers(0, 40, (200, 3))})
    histogram = [(*h, int(n)) for h, n in zip(histogram, rng.integers(1, 50, len(histogram)), strict=True)]
    got = interpolation.learn_mixture(histogram, 100_000, 5000)
    assert np.allclose(got, mixed(histogram, 100_000, 5000), atol=1e-9) and np.allclose(got.sum(1), 1) and got[0, 0] == 0


def test_language_model_over_many_chunks_and_ranges(spark, small, monkeypatch):
    # Chunks and ranges grow, to different sizes.
    monkeypatch.setattr(interpolation, "CHUNK", 2000)
    monkeypatch.setattr(interpolation, "RANGE_TOKENS", 1500)
    monkeypatch.setattr(interpolation, "GROWS_FROM", 60_000)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    alike(interpolation.score(docs).collect(), counted([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_language_model_edge_rows(spark):
    docs = [(1, None), (2, ""), (None, "Aé B\tb"), (3, "a " * 3000), (3, "a b"), (3, "a b"), (5, "B b\nB"), (15, " ")]
    frame = spark.createDataFrame([(*d, 0.0, 0, 0, 0) for d in docs], DOCS)
    alike(interpolation.score(frame).collect(), counted(docs))
    assert interpolation.score(frame.limit(0)).collect() == []
    alone = interpolation.score(frame.filter(F.crc32(F.col("doc_id").cast("string")) % 10 == 0)).collect()
    assert all(math.isfinite(r["score"]) for r in alone)

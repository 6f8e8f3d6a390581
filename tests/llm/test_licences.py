"""Licence scans against a plain search word by word; expressions against a recursive parser."""

from __future__ import annotations

import random
import re

import numpy as np

from marketloom.llm import licences, queries, textops

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_words int, score string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, phrases):
    """(word, phrase) of every place, by comparing at every word."""
    w = WORD.findall(lowered(text))
    out = []
    for i in range(len(w)):
        for p in phrases:
            own = p.split(" ")
            if w[i : i + len(own)] == own:
                out.append((i, p))
    return len(w), sorted(out)


def test_query_equals_a_plain_search(spark, medium):
    base = dict(queries.LICENCE_PHRASES)
    got = {r["doc_id"]: r for r in queries.op12_license_scans(spark, medium).collect()}
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        n, places = plain(d["text"], licences.NOTICES)
        own = [(i, p) for i, p in places if p in base]
        r = got[d["doc_id"]]
        where = [i for i, _ in own]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(own), min(where, default=None), max(where, default=None))
        assert r["base_labels"] == ",".join(sorted({base[p] for _, p in own}))
        # No text of these tables has a tag, so all labels come from phrases.
        assert r["labels"] == ",".join(sorted({licences.NOTICES[p][0] for _, p in places}))
        assert (r["score"] > 0) == bool(places) and 0 <= r["score"] <= 1
        some += bool(own)
    assert some > 10


def test_places_across_parts(monkeypatch):
    text = ("all rights reserved cc by mit license é general public license version 3 " * 5).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, owner = textops.words(data, np.array([0, 200, len(text)]), licences._BREAKS)
    names = list(licences.NOTICES)
    whole = licences.places(licences._automaton(names), names, data, start, end, owner)
    assert len(whole) > 20
    for words in (1, 2, 7):
        monkeypatch.setattr(licences, "WORDS", words)
        assert licences.places(licences._automaton(names), names, data, start, end, owner) == whole


def test_phrases_among_any_punctuation_and_letters(spark):
    rng = random.Random(3)
    bits = ["CC", "by", "NC", "all", "rights", "Reserved", "é", "ccby", "mit", "license", "general", "public", "License", "日本", "x9"]
    gaps = [" ", "\n", "-", ". ", "_", "\t(", "", " "]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(0, 40))), i, "s") for i in range(300)]
    rows += [(None, None, 1, "s"), (1000, "", 1, None), (1001, "cc", 1, None), (1002, "by all rights reserved", 1, None), (1003, "cc by " * 50_000, 1, None)]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        n, places = plain(text, licences.NOTICES)
        assert found[i]["n_words"] == n
        assert [(x["word"], x["phrase"]) for x in found[i]["notices"]] == places
        assert (found[i]["restriction"] == -1) == (not places)
    assert licences.scan(spark.createDataFrame([], DOCS)).count() == 0


IDS = ["mit", "gpl-2.0-only", "apache-2.0", "lgpl-2.1+", "cc-by-nc-4.0", "licenseref-own"]


def grown(rng, deep):
    """A random expression: its text, the operator on top, its ids and restriction."""
    if not deep or rng.random() < 0.3:
        i = rng.choice(IDS)
        level = {"m": 0, "g": 2, "a": 0, "l": 1 if i.startswith("lgpl") else 3, "c": 3}[i[0]]
        if rng.random() < 0.3:
            return f"{i} WITH classpath-exception-2.0", "with", {f"{i} with classpath-exception-2.0"}, 1 if level == 2 else level
        return i.upper() if rng.random() < 0.3 else i, "id", {i}, level
    op = rng.choice(["or", "and"])
    sides = [grown(rng, deep - 1) for _ in range(2)]
    # The right side of the same operator may stand without parentheses as well.
    texts = [f"( {t})" if (op == "and" and top == "or") or rng.random() < 0.3 else t for t, top, _, _ in sides]
    level = (min if op == "or" else max)(s[3] for s in sides)
    return f"{texts[0]} {op.upper() if rng.random() < 0.5 else op} {texts[1]}", op, sides[0][2] | sides[1][2], level


def test_expressions_evaluate_like_they_were_made():
    rng = random.Random(8)
    for _ in range(2000):
        text, _, ids, level = grown(rng, 4)
        postfix, read = licences.parse(" " + text.lower() + rng.choice(["", " */", " -->", " , see above", " foo"]))
        assert licences.evaluate(postfix) == (sorted(ids), level)
        assert read == len(text) + 1


def test_broken_expressions_give_what_can_be_read():
    told = lambda line: licences.evaluate(licences.parse(line)[0])
    assert told(" mit or") == (["mit"], 0)
    assert told("(mit and (gpl-3.0 or") == (["gpl-3.0", "mit"], 2)
    assert told("((") == ([], -1) and told("") == ([], -1) and told(") mit") == ([], -1) and told("or mit") == ([], -1)
    assert told("mit) and gpl") == (["mit"], 0)
    assert told("mit with (x") == (["mit"], 0)
    assert told("gpl-2.0 with classpath-exception-2.0 with other-exception") == (["gpl-2.0 with classpath-exception-2.0"], 1)
    assert told("mit and nothing known") == (["mit"], 0)
    assert told("gplx") == ([], -1)


def test_tags_are_read_from_texts(spark):
    rows = [
        (1, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 # x\nMIT", 1, ""),
        (2, "SPDX License Identifier: MIT\nspdx-license-identifier MIT\nspdx-license-identifier:\nMIT", 1, ""),
        (3, "é License-Expression:GPL-3.0-or-later WITH Autoconf-exception-3.0\n all rights reserved", 1, ""),
        (4, "SPDX-License-Identifier:" + " (" * 30_000 + " MIT", 1, ""),
        (5, "SPDX-License-Identifier:", 1, ""),
    ]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    tags = {i: [(e["word"], e["expression"], e["ids"], e["restriction"]) for e in r["expressions"]] for i, r in got.items()}
    assert tags[1] == [(0, "(mit or gpl-2.0-only) and apache-2.0", ["apache-2.0", "gpl-2.0-only", "mit"], 0)]
    assert tags[2] == [] and tags[5] == []
    assert tags[3] == [(1, "gpl-3.0-or-later with autoconf-exception-3.0", ["gpl-3.0-or-later with autoconf-exception-3.0"], 1)]
    assert tags[4][0][2:] == (["mit"], 0)
    assert got[3]["restriction"] == 3 and got[1]["restriction"] == 0 and got[2]["restriction"] == -1
    assert abs(got[3]["score"] - (1 - 0.01 * 0.3)) < 1e-12


def test_words_are_gathered_block_by_block(monkeypatch):
    monkeypatch.setattr(textops, "BLOCK", 16)
    text = b"a bc   def ghijklmnopqrstuvwxyzabcd e f  "
    data = np.frombuffer(text, np.uint8)
    start, end, owner = textops.words(data, np.array([0, 5, len(text)]))
    assert textops.gathered(data, start, end).tobytes() == b"a bc def ghijklmnopqrstuvwxyzabcd e f "
    assert textops.joined(data, start, end, owner, 2).to_pylist() == ["a bc", "def ghijklmnopqrstuvwxyzabcd e f"]

"""Conversation repair against all edits tried one by one, and against a search for the cheapest."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re

import pytest

from marketloom.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, place int"
SPACE = " \t\n\x0b\f\r"
LEGAL = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def summary(rows):
    """Rows (turn, role, text) in order: gaps and counts."""
    turns = {t for t, *_ in rows if t is not None}
    told, pairs = faults(rows), zip(rows[:-1], rows[1:], strict=True)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(told.count(f) for f in ("blank", "duplicate", "truncated")), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)


def choices(role, text, fault):
    """(cost, edit, line) of one row."""
    yield 4, "D", None
    if fault in ("", "truncated"):
        more = 3 if fault else 0
        yield more, "K", (role, text)
        for name in NAMES.values():
            yield 3 + more, "R", (name, text)


def every_edit(rows):
    """The least (cost, audit, lines) by trying all edits, with up to two inserts between rows."""
    gaps = [(3 * len(g), "I" * len(g), [(NAMES[x], "") for x in g]) for g in ("", "u", "a", "ua")]
    each = [gaps]
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        each += [[(c, e, [line] if line else []) for c, e, line in choices(role, text, fault)], gaps]
    best = None
    for way in itertools.product(*each):
        lines = [x for _, _, part in way for x in part]
        if LEGAL.fullmatch("".join(role[:1] or "?" for role, _ in lines)):
            one = (sum(c for c, *_ in way), "".join(e for _, e, _ in way), [f"{r}:{t}" for r, t in lines])
            best = one if best is None or one < best else best
    return best


def cheapest(rows):
    """The same by Dijkstra's search, for longer conversations."""
    told, heap, done = faults(rows), [(0, "", 0, 0, ())], set()
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        for x, name in NAMES.items():
            if (state, x) in after:
                heapq.heappush(heap, (cost + 3, audit + "I", i, after[state, x], (*lines, f"{name}:")))
        if i < len(rows):
            for c, e, line in choices(rows[i][1], rows[i][2], told[i]):
                if line is None:
                    heapq.heappush(heap, (cost + c, audit + e, i + 1, state, lines))
                elif (state, line[0][:1]) in after:
                    heapq.heappush(heap, (cost + c, audit + e, i + 1, after[state, line[0][:1]], (*lines, f"{line[0]}:{line[1]}")))


def read(spark, rows):
    report, ordered = repair.repair(spark.createDataFrame(rows, TURNS))
    said = {}
    for r in repair.repaired(report, ordered).collect():
        said.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repair.repaired(report, ordered)).collect()}
    out = {}
    for r in report.collect():
        lines = [x for _, x in sorted(said.get(r["conv_id"], []))]
        assert digests.get(r["conv_id"], hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[r["conv_id"]] = (tuple(r)[1:6], (r["cost"], r["audit"], lines))
    return out


def made(rng, conv, n):
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "User"], ["Hi.", "Well?", "cut off", " \n", "", "Yes! ", "é."]
    return [(conv, t, rng.choice(roles), rng.choice(texts), 5) for t in range(n)]


def test_all_edits_of_short_conversations(spark):
    rng = random.Random(11)
    rows = [r for conv in range(120) for r in made(rng, conv, rng.randint(1, 3))]
    got = read(spark, rows)
    for conv in range(120):
        own = [r[1:4] for r in rows if r[0] == conv]
        assert got[conv] == (summary(own), every_edit(own)) == (summary(own), cheapest(own))


@pytest.mark.parametrize("block, fan, parts", [(12, 64, 8), (2, 2, 8), (1, 4, 40)])
def test_long_conversations_in_any_blocks(spark, monkeypatch, block, fan, parts):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(block)
        rows = [r for conv in range(30) for r in made(rng, conv, rng.choice([1, 4, 9, 40]))] + made(rng, 1000, 400)
        # Other texts than the few, so that not all rows are duplicates.
        rows = [(c, t, role, text.replace("Hi", f"Hi {rng.randint(0, 99)}").replace("cut", f"cut {t}"), p) for c, t, role, text, p in rows]
        got = read(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for conv in got:
        own = [r[1:4] for r in rows if r[0] == conv]
        assert got[conv] == (summary(own), cheapest(own))


def test_odd_conversations(spark):
    long = "a " * 300_000
    rows = [
        (1, None, "user", "Null turns come first.", 1), (1, 4, "assistant", "Good.", 1), (1, 9, "user", None, 1),
        (None, 1, "user", "One?", 1), (None, 1, "user", "One?", 1), (None, 2, "assistant", "Two.", 1),
        (3, None, None, None, 1), (4, -(2**63), "assistant", "x.", 1), (4, 2**63 - 1, "user", "y.", 1),
        (5, 0, "user", long, 1), (5, 1, "assistant", long + ".", 1), (6, 0, "system", "Only.", 1), (7, 0, "", "?", 1),
    ]
    got = read(spark, rows)
    assert got[1] == ((4, 1, 0, 0, 0), (4, "KKD", ["user:Null turns come first.", "assistant:Good."]))
    assert got[None] == ((0, 0, 1, 0, 1), (4, "KDK", ["user:One?", "assistant:Two."]))
    assert got[3] == ((0, 1, 0, 0, 0), (4, "D", []))
    assert got[4][1] == (6, "IKKI", ["user:", "assistant:x.", "user:y.", "assistant:"])
    # More gaps than a long holds are told as none.
    assert got[4][0] == (0, 0, 0, 0, 0)
    assert got[5] == ((0, 0, 0, 1, 0), (3, "KK", [f"user:{long}", f"assistant:{long}."]))
    assert got[6] == ((0, 0, 0, 0, 0), (4, "D", []))
    assert got[7] == ((0, 0, 0, 0, 0), (4, "D", []))
    assert read(spark, []) == {}


def test_damaged_rows_are_those_of_the_contract(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (0, 1, None)] + [(None, None, None, None)]
    import zlib

    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

"""Similar strings and names within texts against all pairs."""

from __future__ import annotations

import random

import pytest

from marketloom.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.7, 0.8, 0.88, 1.0])
def test_pairs_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 14))) for _ in range(60)]

    def bent(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        return "".join(x)

    left, right = [*base, None, "", "aaaa", "aaaaaaaa"], [*(bent(x) for x in base + base), "aaa", "aaaaaaa", None, ""]
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right + right[:9]], "b string")
    want = {}
    for x in filter(None, set(left)):
        for y in filter(None, set(right)):
            s = 1 - distance(x, y) / max(len(x), len(y))
            if s >= least - 1e-9:
                want[x, y] = s
    rows = fuzzy.similar(a, b, "a", "b", least).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 3
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_too_small_a_share_is_refused(spark):
    with pytest.raises(ValueError):
        fuzzy.similar(spark.range(1), spark.range(1), "id", "id", 0.5)


def test_names_within_texts(spark):
    names = ["small ring", "ring", "red", "big red ring of steel", "", None]
    texts = ["a small ring of steel", "smallring", "ring", "the big red ring of steel red", "red  ring", "", None]
    got = fuzzy.held(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "n string"), "t", "n").collect()
    want = {(t, n) for t in filter(None, texts) for n in filter(None, names) if f" {n} " in f" {t} "}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 7


def test_strings_without_a_fitting_length_never_meet(spark, monkeypatch):
    """Long texts made of the names' own grams have no name of a fitting length, so their grams aren't looked at."""
    given, plain = [], fuzzy._firsts

    def seen(rows, *more):
        given.append(rows.count())
        return plain(rows, *more)

    monkeypatch.setattr(fuzzy, "_firsts", seen)
    names, texts = [f"ring {k}" for k in range(10, 40)], [f"ring {k} " * 6 for k in range(10, 40)]
    a = spark.createDataFrame([(x,) for x in [*texts, "ring 10"]], "a string")
    got = fuzzy.similar(a, spark.createDataFrame([(x,) for x in names], "b string"), "a", "b", 0.9).collect()
    assert [tuple(r) for r in got] == [("ring 10", "ring 10", 1.0)]
    assert given == [1, 30]

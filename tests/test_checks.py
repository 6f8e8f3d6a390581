"""Checks that fail on planted rows, ranks dealt over ranges, and bytes of several encodings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions.ranks import dealt_rank, rank_average
from marketloom.plans import catalog
from marketloom.plans.research import quality_checks
from marketloom.plans.rules import decoded_text

GOOD = {
    "bars": [(1, "2001-05-01", 10.0, 0.01), (2, "2001-05-01", 20.0, None), (1, "2001-04-01", 9.9, None)], "stocks": [(1,), (2,)],
    "lines": [(7, 1, 5.0, 100.0, 0.1), (7, 2, 1.0, 10.0, 0.0)], "orders": [(7, 100.0, "F", "2001-05-03")], "supplier": [(1, 5.0)],
}


def statuses(spark, **changed):
    t = {**GOOD, **changed}
    bars = spark.createDataFrame(t["bars"], "symbol long, date string, close double, r double").withColumn("date", F.col("date").cast("date"))
    orders = spark.createDataFrame(t["orders"], "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderdate string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    lines = spark.createDataFrame(t["lines"], "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double")
    told = quality_checks(bars, spark.createDataFrame(t["stocks"], "symbol long"), lines, orders, spark.createDataFrame(t["supplier"], "s_suppkey long, s_acctbal double"), "2001-06-01").collect()
    return {r["name"]: r["status"] for r in told}


def test_each_check_fails_on_a_row_planted_for_it(spark):
    fine = statuses(spark)
    assert len(fine) == 8 and set(fine.values()) == {"PASS"}
    planted = {
        "completeness": ({"stocks": [*GOOD["stocks"], (3,)]}, "FAIL"), "price_limit": ({"bars": [*GOOD["bars"], (2, "2001-05-01", 1.0, -0.2)]}, "FAIL"),
        "volume_not_negative": ({"lines": [*GOOD["lines"], (8, 1, -1.0, 0.0, 0.0)]}, "FAIL"), "volume_split": ({"lines": [*GOOD["lines"], (7, 1, 1.0, 30.0, 0.0)]}, "WARN"),
        "freshness": ({"orders": [(7, 100.0, "F", "2000-05-03")]}, "WARN"), "actions_applied": ({"supplier": [(1, -950.0)]}, "FAIL"),
        "announced": ({"orders": [(7, 100.0, "P", "2001-05-03")]}, "FAIL"), "point_in_time": ({"bars": [*GOOD["bars"], (1, "2001-07-01", 1.0, 0.0)]}, "FAIL"),
    }
    for name, (change, status) in planted.items():
        got = statuses(spark, **change)
        assert {n for n, s in got.items() if s != "PASS"} == {name} and got[name] == status


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_ranks_dealt_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(k, rng.choice("ab"), rng.choice([None, float(rng.randint(0, 30)), rng.gauss(0, 5)])) for k in range(800)] + [(900, "c", None), (901, "d", 1.0)]
    frame = spark.createDataFrame(rows, "k long, g string, x double")
    got = {r["k"]: r["rank"] for r in dealt_rank(frame, "x", "g", "rank", ranges).collect()}
    want = {r["k"]: r["rank"] for r in frame.select("k", rank_average(F.col("x"), "g").alias("rank")).collect()}
    assert got == want and len(got) == 802


def test_bytes_of_several_encodings(spark):
    texts = ["plain", "café déjà", "naïve “quoted” – €5", "日本語", ""]
    rows, want = [], []
    for t in texts:
        for name, mark, codec in (("utf-8", b"\xef\xbb\xbf", "utf-8"), ("utf-16le", b"\xff\xfe", "utf-16-le"), ("utf-16be", b"\xfe\xff", "utf-16-be"), ("utf-8", b"", "utf-8"), ("iso-8859-1", b"", "latin-1"), ("windows-1252", b"", "cp1252")):
            try:
                raw = mark + t.encode(codec)
            except UnicodeEncodeError:
                continue
            if not mark and codec in ("latin-1", "cp1252"):
                name = "utf-8" if t.isascii() else "iso-8859-1" if not any(0x80 <= b <= 0x9F for b in raw) else "windows-1252"
            rows.append((len(rows), bytearray(raw)))
            want.append((name, t))
    charset, text = decoded_text(F.col("raw"))
    got = spark.createDataFrame(rows, "k int, raw binary").select("k", charset, text).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == want


def test_all_encodings_occur_in_the_query(spark, medium):
    seen = {r["charset"] for r in catalog.QUERIES["text_decoding"](spark, medium).collect()}
    assert seen == {"utf-8", "utf-16le", "utf-16be", "iso-8859-1", "windows-1252"}

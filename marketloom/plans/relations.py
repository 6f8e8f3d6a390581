"""Graphs of relations between entities: cycles, ownership, paths, exposure and its change.

Entities are the suppliers. Each line of an order passes on to the next line's supplier,
which is a relation of the week it was shipped in; all lines count. Its kind follows
from the line's return flag and status, its amount is the discount given; an amount of
zero isn't quantified. Exposure and its change are between nations, by year.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators.graphs import cycles, strong_components
from marketloom.operators.steps import discard, written
from marketloom.plans.catalog import query
from marketloom.plans.risk import r6
from marketloom.sources.tables import SQL_FLOWS, flows, load

SQL_RELATIONS = """relations AS (
  SELECT * FROM (
    SELECT l_suppkey AS source, lead(l_suppkey) OVER w AS target, CAST(date_trunc('week', l_shipdate) AS DATE) AS period, l_extendedprice * l_discount AS amount, l_orderkey, l_linenumber, l_linestatus = 'F' AS filed,
      CASE WHEN l_returnflag = 'R' THEN 'lends_to' WHEN l_returnflag = 'A' THEN 'guarantees_for' WHEN l_linestatus = 'O' THEN 'transacts_with' ELSE 'creditor_of' END AS kind
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_returnflag, l_linestatus)
  ) WHERE source <> target
), edges AS (
  SELECT period, source, target, sum(amount) AS amount, max(CAST(amount > 0 AS INT)) AS quantified, max(CAST(amount > 0 AND kind <> 'transacts_with' AS INT)) AS financing FROM relations GROUP BY ALL
)"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    kind = F.when(F.col("l_returnflag") == "R", "lends_to").when(F.col("l_returnflag") == "A", "guarantees_for").when(F.col("l_linestatus") == "O", "transacts_with").otherwise("creditor_of")
    lines = load(spark, d, "lineitem").withColumn("target", F.lead("l_suppkey").over(w)).filter("l_suppkey <> target")
    return lines.select(
        F.col("l_suppkey").alias("source"), "target", F.trunc(F.col("l_shipdate").cast("date"), "week").alias("period"), (F.col("l_extendedprice") * F.col("l_discount")).alias("amount"),
        kind.alias("kind"), "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").alias("filed"),
    )


def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per period, source and target: amount, and whether some relation between them is quantified, or quantified financing."""
    amount = F.col("amount") > 0
    return relations(spark, d).groupBy("period", "source", "target").agg(
        F.sum("amount").alias("amount"), F.max(amount.cast("int")).alias("quantified"), F.max((amount & (F.col("kind") != "transacts_with")).cast("int")).alias("financing")
    )


@query(
    "relation_best_evidence",
    f"""WITH {SQL_RELATIONS} SELECT period, source, target, kind, l_orderkey, l_linenumber, round(amount, 4) AS amount, CAST(filed AS INT) + CAST(amount > 0 AS INT) AS evidence FROM relations
QUALIFY row_number() OVER (PARTITION BY period, source, target ORDER BY CAST(filed AS INT) + CAST(amount > 0 AS INT) DESC, amount DESC, l_orderkey, l_linenumber, kind) = 1""",
    dates=("period",),
)
def relation_best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of all relations of a pair and period, that of best evidence: filed and quantified ones first, then the largest."""
    r = relations(spark, d).withColumn("evidence", F.col("filed").cast("int") + (F.col("amount") > 0).cast("int"))
    by = F.struct("evidence", "amount", -F.col("l_orderkey"), -F.col("l_linenumber"), -F.ascii("kind"), -F.length("kind"))
    best = r.groupBy("period", "source", "target").agg(F.max_by(F.struct("kind", "l_orderkey", "l_linenumber", F.round("amount", 4).alias("amount"), "evidence"), by).alias("b"))
    return best.select("period", "source", "target", "b.*")


LONGEST = 8
_WALK = f"""walk AS (SELECT period, [source, target] AS path, target AS at, [amount] AS amounts, quantified AS q, financing AS f, false AS closed FROM edges WHERE source < target
UNION ALL SELECT w.period, CASE WHEN e.target = w.path[1] THEN w.path ELSE list_append(w.path, e.target) END, e.target, list_append(w.amounts, e.amount), w.q + e.quantified, w.f + e.financing, e.target = w.path[1]
FROM walk w JOIN edges e ON e.period = w.period AND e.source = w.at
WHERE NOT w.closed AND ((e.target = w.path[1] AND len(w.path) >= 3) OR (e.target > w.path[1] AND NOT list_contains(w.path, e.target) AND len(w.path) < {LONGEST}))),
loops AS (SELECT period, array_to_string(path, '>') AS cycle, len(path) AS nodes, round(list_min(list_filter(amounts, lambda x: x > 0)), 4) AS bottleneck, q AS quantified, f AS financing FROM walk WHERE closed AND q >= 2 AND f >= 1)"""


def loops(spark: SparkSession, d: str) -> DataFrame:
    """period, cycle, nodes, bottleneck (the least amount above zero), quantified and financing edges of each flow that comes back."""
    e = written(flow_edges(spark, d))
    found = cycles(e.select(F.unix_date("period").cast("long").alias("grp"), F.col("source").alias("u"), F.col("target").alias("v")), LONGEST)
    found = found.select(F.date_from_unix_date(F.col("grp").cast("int")).alias("period"), "path")
    ends = F.concat(F.slice("path", 2, LONGEST), F.slice("path", 1, 1))
    each = found.select("period", "path", F.explode(F.arrays_zip(F.col("path").alias("source"), ends.alias("target"))).alias("e")).select("period", "path", "e.source", "e.target")
    told = each.join(e, ["period", "source", "target"]).groupBy("period", "path").agg(
        F.round(F.min(F.when(F.col("amount") > 0, F.col("amount"))), 4).alias("bottleneck"), F.sum("quantified").alias("quantified"), F.sum("financing").alias("financing")
    )
    told = told.filter("quantified >= 2 AND financing >= 1")
    return told.select("period", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"), F.size("path").cast("long").alias("nodes"), "bottleneck", "quantified", "financing", "path")


@query("flow_cycles", f"WITH RECURSIVE {SQL_RELATIONS}, {_WALK} SELECT * FROM loops", dates=("period",))
def flow_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Flows of one period that come back through three to eight entities, two of them quantified and one of these financing."""
    return loops(spark, d).drop("path")


DEEPEST = 8
#: A stake counts as control from this share of the largest stake in an entity.
CONTROL = 0.8
SQL_OWNS = f"""stakes AS (SELECT source AS owner, target AS owned, sum(amount) AS stake FROM relations GROUP BY ALL HAVING sum(amount) > 0),
owns AS (SELECT owner, owned FROM stakes QUALIFY stake >= {CONTROL} * max(stake) OVER (PARTITION BY owned))"""
_REACH = f"r AS (SELECT owner, owned, 1 AS steps FROM owns UNION SELECT r.owner, o.owned, r.steps + 1 FROM r JOIN owns o ON o.owner = r.owned WHERE r.steps < {DEEPEST})"


#: Tasks that the owners of one entity are dealt to.
DEALT = 16


def owns(spark: SparkSession, d: str) -> DataFrame:
    """owner and owned: the largest stakes in an entity over all periods, and those near it. Owners may own each other.

    Relations are written, so that their lines' shuffle goes, and are dealt once: a stake
    far from the largest of its share of the owners is far from the largest of all, and
    few are left to be compared with the others.
    """
    r = written(relations(spark, d).select(F.col("source").alias("owner"), F.col("target").alias("owned"), "amount"))
    dealt = r.withColumn("share", F.pmod(F.xxhash64("owner"), F.lit(DEALT))).repartition("owned", "share")
    near = dealt.groupBy("owner", "owned", "share").agg(F.sum("amount").alias("stake")).filter("stake > 0")
    for by in (["owned", "share"], ["owned"]):
        near = near.withColumn("most", F.max("stake").over(Window.partitionBy(*by))).filter(F.col("stake") >= CONTROL * F.col("most")).drop("most")
    out = written(near.select("owner", "owned"))
    discard(r)
    return out


#: Longs of a row of ``reach``, and about as many rows as a step of it passes on at most.
WIDE, PASSED = 16, 12_000_000
_WORDS = [f"w{i}" for i in range(WIDE)]


def reaches(edges: DataFrame, deepest: int = DEEPEST, passed: int = PASSED) -> Iterator[list[DataFrame]]:
    """owner, block, w0, w1, ... and steps: what each step of a walk down from the owners reaches for the first time, up to ``deepest``.

    The owned are bits, 64 of them a word and WIDE words a row (owned = 64 WIDE block +
    64 word + bit), so a step joins and adds up rows of many pairs, and only what is new
    goes on. Blocks don't meet, so they are walked in rounds, as many of them at a time as
    pass on about ``passed`` rows a step, by the rounds before. A round is a list of written
    steps, made when it is asked for; who doesn't need them any more discards them.
    """
    e = written(edges.select("owner", "owned").distinct())
    place = F.shiftright("owned", 6).bitwiseAND(WIDE - 1)
    bit = F.expr("shiftleft(1L, CAST(owned & 63 AS INT))")
    block = F.shiftright("owned", 6 + (WIDE - 1).bit_length())
    none = F.lit(0).cast("long")
    words = [F.bit_or(F.when(place == i, bit).otherwise(none)).alias(w) for i, w in enumerate(_WORDS)]
    first = written(e.groupBy("owner", block.alias("block")).agg(*words).withColumn("steps", F.lit(1)))
    n, owners = e.agg(F.count(F.lit(1)), F.count_distinct("owner")).first()
    blocks = first.select("block").distinct().count()
    parts = max(1, min(blocks, -(-n * blocks // passed)))
    part = F.pmod(F.hash("block"), F.lit(parts))
    begin, take, most = 0, 1, 1
    while begin < parts:
        found = [first.filter(part.between(begin, begin + take - 1))]
        front = found[0]
        for k in range(2, deepest + 1):
            sent = front.join(e.toDF("above", "owner"), "owner").select(F.col("above").alias("owner"), "block", *_WORDS, F.lit(False).alias("had"))
            for before in found:
                sent = sent.unionByName(before.select("owner", "block", *_WORDS, F.lit(True).alias("had")))
            # Dealt first: added up where they are made, rows would become no fewer and need much memory.
            told = [F.bit_or(F.when(F.col("had") == had, F.col(w)).otherwise(none)).alias(f"{w}_{had}") for w in _WORDS for had in (False, True)]
            met = sent.repartition("owner", "block").groupBy("owner", "block").agg(*told)
            met = met.select("owner", "block", *[F.col(f"{w}_False").bitwiseAND(F.bitwise_not(f"{w}_True")).alias(w) for w in _WORDS])
            front = written(met.filter(f"({' | '.join(_WORDS)}) <> 0").withColumn("steps", F.lit(k)))
            rows = front.count()
            if not rows:
                discard(front)
                break
            found.append(front)
            most = max(most, rows // take)
        yield found
        begin += take
        take = max(1, passed * owners // (most * max(1, n)))
    discard(e)


def reach(edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """All rounds of ``reaches``."""
    return reduce(DataFrame.unionByName, [step for found in reaches(edges, deepest) for step in found])


def pairs(found: DataFrame) -> DataFrame:
    """owner, owned and the least number of steps between them."""
    words = found.select("owner", "steps", "block", F.posexplode(F.array(*_WORDS)).alias("i", "bits")).filter("bits <> 0")
    each = words.select("owner", "steps", (F.col("block") * (64 * WIDE) + F.col("i") * 64).alias("at"), "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return each.filter("(shiftright(bits, b) & 1) = 1").select("owner", (F.col("at") + F.col("b")).alias("owned"), "steps")


def controlled(edges: DataFrame, deepest: int = DEEPEST, passed: int = PASSED) -> DataFrame:
    """owner, controlled (how many others it reaches) and circular (whether it reaches itself); rows of ``reaches`` are counted, no pairs made."""
    word = F.element_at(F.array(*_WORDS), (F.shiftright("owner", 6).bitwiseAND(WIDE - 1) + 1).cast("int"))
    own = F.when(F.col("block") == F.shiftright("owner", 6 + (WIDE - 1).bit_length()), F.call_function("shiftright", word, F.col("owner").bitwiseAND(63).cast("int")).bitwiseAND(1)).otherwise(F.lit(0).cast("long"))
    bits = reduce(Column.__add__, [F.bit_count(w) for w in _WORDS])
    parts = []
    for found in reaches(edges, deepest, passed):
        of = reduce(DataFrame.unionByName, found).select("owner", bits.alias("bits"), own.alias("own"))
        parts.append(written(of.groupBy("owner").agg(F.sum("bits").alias("bits"), F.sum("own").alias("own"))))
        discard(*found[1:])
    of = reduce(DataFrame.unionByName, parts).groupBy("owner").agg(F.sum("bits").alias("bits"), F.sum("own").alias("own"))
    return of.select("owner", (F.col("bits") - F.col("own")).alias("controlled"), (F.col("own") > 0).alias("circular"))


def depths(edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """owner and the length of the longest walk down from it, up to ``deepest``; a row an owner and step, no pairs."""
    above = edges.select("owner", "owned").distinct()
    alive = written(above.select("owner").distinct())
    found = alive.withColumn("depth", F.lit(1))
    for k in range(2, deepest + 1):
        alive = written(above.join(alive.withColumnRenamed("owner", "owned"), "owned", "left_semi").select("owner").distinct())
        if alive.isEmpty():
            break
        found = found.unionByName(alive.withColumn("depth", F.lit(k)))
    return found.groupBy("owner").agg(F.max("depth").alias("depth"))


@query("transitive_ownership", f"WITH RECURSIVE {SQL_RELATIONS}, {SQL_OWNS}, {_REACH} SELECT owner, owned, CAST(min(steps) AS INT) AS steps FROM r WHERE owner <> owned GROUP BY ALL")
def transitive_ownership(spark: SparkSession, d: str) -> DataFrame:
    """What each owner controls, directly or through others, over at most eight steps."""
    return pairs(reach(owns(spark, d))).filter("owner <> owned").select("owner", "owned", "steps")


@query("ownership_depth", f"WITH RECURSIVE {SQL_RELATIONS}, {SQL_OWNS}, {_REACH} SELECT owner, count(DISTINCT owned) FILTER (owned <> owner) AS controlled, CAST(max(steps) AS INT) AS depth, bool_or(owner = owned) AS circular FROM r GROUP BY owner")
def ownership_depth(spark: SparkSession, d: str) -> DataFrame:
    """How many an owner controls, the longest chain below it, up to eight, and whether a chain comes back to it."""
    o = owns(spark, d)
    return controlled(o).join(depths(o), "owner").select("owner", "controlled", "depth", "circular")


@query(
    "ownership_components",
    f"""WITH RECURSIVE {SQL_RELATIONS}, {SQL_OWNS}, far AS (SELECT owner, owned FROM owns UNION SELECT f.owner, o.owned FROM far f JOIN owns o ON o.owner = f.owned),
both_ways AS (SELECT a.owner AS entity, min(a.owned) AS component FROM far a JOIN far b ON b.owner = a.owned AND b.owned = a.owner GROUP BY ALL)
SELECT entity, component, count(*) OVER (PARTITION BY component) AS members FROM both_ways QUALIFY members > 1""",
)
def ownership_components(spark: SparkSession, d: str) -> DataFrame:
    """Entities that own each other through any number of steps: strong components of the ownership graph."""
    c = strong_components(owns(spark, d).select(F.lit(0).cast("long").alias("grp"), F.col("owner").alias("u"), F.col("owned").alias("v")))
    members = c.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return c.join(members, "component").select(F.col("node").alias("entity"), "component", "members")


@query(
    "ownership_loops",
    f"""WITH RECURSIVE {SQL_RELATIONS}, {SQL_OWNS}, w AS (SELECT [owner, owned] AS path, owned AS at, false AS closed FROM owns WHERE owner < owned
UNION ALL SELECT CASE WHEN o.owned = w.path[1] THEN w.path ELSE list_append(w.path, o.owned) END, o.owned, o.owned = w.path[1] FROM w JOIN owns o ON o.owner = w.at
  WHERE NOT w.closed AND (o.owned = w.path[1] OR (o.owned > w.path[1] AND NOT list_contains(w.path, o.owned) AND len(w.path) < {LONGEST})))
SELECT array_to_string(path, '>') AS loop, len(path) AS nodes FROM w WHERE closed""",
)
def ownership_loops(spark: SparkSession, d: str) -> DataFrame:
    """Chains of ownership of two to eight entities that come back to where they began."""
    found = cycles(owns(spark, d).select(F.lit(0).cast("long").alias("grp"), F.col("owner").alias("u"), F.col("owned").alias("v")), LONGEST, shortest=2)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("loop"), F.size("path").cast("long").alias("nodes"))


@query(
    "two_hop_flows",
    f"""WITH {SQL_RELATIONS}, o AS (SELECT s_suppkey AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0), e AS (SELECT * FROM edges WHERE quantified = 1)
SELECT a.period, a.source, a.target AS via, b.target AS endpoint FROM e a JOIN e b ON a.target = b.source AND a.period = b.period
WHERE b.target <> a.source AND NOT (a.source IN (SELECT k FROM o) AND a.target IN (SELECT k FROM o) AND b.target IN (SELECT k FROM o))""",
    dates=("period",),
)
def two_hop_flows(spark: SparkSession, d: str) -> DataFrame:
    """Quantified flows over one stop, within a period, that leave a group (the suppliers of one region) at some end."""
    nations = load(spark, d, "nation").filter("n_regionkey = 0").select("n_nationkey")
    inside = load(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("k"))
    e = flow_edges(spark, d).filter("quantified = 1").select("period", "source", "target")
    # Whether an end lies in the group is told once an edge, before edges meet.
    for end in ("source", "target"):
        e = e.join(inside.select(F.col("k").alias(end), F.lit(True).alias(f"{end}_in")), end, "left")
    e = written(e.select("period", "source", "target", (F.col("source_in").isNotNull() & F.col("target_in").isNotNull()).alias("inner")))
    a = e.select("period", "source", F.col("target").alias("via"), F.col("inner").alias("one"))
    b = e.select("period", F.col("source").alias("via"), F.col("target").alias("endpoint"), F.col("inner").alias("two"))
    return a.join(b, ["period", "via"]).filter("endpoint <> source AND NOT (one AND two)").select("period", "source", "via", "endpoint")


_SUSPICIOUS = """suspicious AS (SELECT a.period, a.source, count(*) AS paths, round(sum(least(a.amount, b.amount)), 4) AS moved FROM edges a JOIN edges b ON a.target = b.source AND a.period = b.period
  JOIN supplier s ON s.s_suppkey = a.source JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN supplier t ON t.s_suppkey = b.target JOIN nation m ON m.n_nationkey = t.s_nationkey
  WHERE a.financing = 1 AND b.financing = 1 AND b.target <> a.source AND n.n_regionkey <> m.n_regionkey GROUP BY ALL)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return load(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")


@query("suspicious_flows", f"WITH {SQL_RELATIONS}, {_SUSPICIOUS} SELECT * FROM suspicious", dates=("period",))
def suspicious_flows(spark: SparkSession, d: str) -> DataFrame:
    """Financing over one stop, within a period, that ends outside the source's region."""
    region = regions(spark, d)
    e = written(flow_edges(spark, d).filter("financing = 1").select("period", "source", "target", "amount"))
    a = e.join(region.toDF("source", "home"), "source").select("period", "source", "home", F.col("target").alias("via"), F.col("amount").alias("one"))
    b = e.join(region.toDF("target", "abroad"), "target").select("period", F.col("source").alias("via"), F.col("target").alias("endpoint"), "abroad", F.col("amount").alias("two"))
    x = a.join(b, ["period", "via"]).filter("endpoint <> source AND home <> abroad")
    return x.groupBy("period", "source").agg(F.count(F.lit(1)).alias("paths"), F.round(F.sum(F.least("one", "two")), 4).alias("moved"))


@query(
    "graph_assessment",
    f"""WITH RECURSIVE {SQL_RELATIONS}, {_WALK}, {_SUSPICIOUS}, inflow AS (SELECT target AS entity, period, sum(amount) AS got FROM edges GROUP BY ALL), outflow AS (SELECT source AS entity, period, sum(amount) AS paid FROM edges GROUP BY ALL),
members AS (SELECT period, CAST(unnest(string_split(cycle, '>')) AS BIGINT) AS entity, bottleneck FROM loops), m AS (SELECT period, entity, count(*) AS cycles, max(bottleneck) AS bottleneck FROM members GROUP BY ALL),
g AS (SELECT entity, period, round(coalesce(got, 0), 4) AS got, round(coalesce(paid, 0), 4) AS paid, coalesce(cycles, 0) AS cycles, bottleneck, coalesce(paths, 0) AS paths
  FROM inflow FULL JOIN outflow USING (entity, period) LEFT JOIN m USING (entity, period) LEFT JOIN (SELECT period, source AS entity, paths FROM suspicious) USING (entity, period))
SELECT *, CASE WHEN cycles > 0 AND paths > 0 THEN 'HIGH' WHEN cycles > 0 OR paths >= 3 THEN 'ELEVATED' WHEN paths > 0 THEN 'WATCH' ELSE 'LOW' END AS verdict FROM g""",
    dates=("period",),
)
def graph_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's flows in a period, the cycles it is on with the widest bottleneck, its suspicious paths, and a verdict."""
    e = written(flow_edges(spark, d))
    zero = F.lit(0.0)
    sides = e.select(F.col("target").alias("entity"), "period", F.col("amount").alias("got"), zero.alias("paid")).unionByName(e.select(F.col("source").alias("entity"), "period", zero.alias("got"), F.col("amount").alias("paid")))
    sides = sides.groupBy("entity", "period").agg(F.round(F.sum("got"), 4).alias("got"), F.round(F.sum("paid"), 4).alias("paid"))
    on = loops(spark, d).select("period", F.explode("path").alias("entity"), "bottleneck").groupBy("entity", "period").agg(F.count(F.lit(1)).alias("cycles"), F.max("bottleneck").alias("bottleneck"))
    bad = suspicious_flows(spark, d).select(F.col("source").alias("entity"), "period", "paths")
    none = F.lit(0).cast("long")
    g = sides.join(on, ["entity", "period"], "left").join(bad, ["entity", "period"], "left").withColumns({"cycles": F.coalesce("cycles", none), "paths": F.coalesce("paths", none)})
    verdict = F.when((F.col("cycles") > 0) & (F.col("paths") > 0), "HIGH").when((F.col("cycles") > 0) | (F.col("paths") >= 3), "ELEVATED").when(F.col("paths") > 0, "WATCH").otherwise("LOW")
    return g.select("entity", "period", "got", "paid", "cycles", "bottleneck", "paths", verdict.alias("verdict"))


def exposure_score(ratio: Column) -> Column:
    """0 to 100, steeper where exposure is small."""
    return (
        F.when(ratio.isNull() | (ratio <= 0), 0.0).when(ratio <= 0.1, ratio * 100).when(ratio <= 0.25, 10 + (ratio - 0.1) / 0.15 * 25)
        .when(ratio <= 0.5, 35 + (ratio - 0.25) / 0.25 * 35).otherwise(F.least(F.lit(100.0), 70 + (ratio - 0.5) / 0.5 * 30))
    )


_SCORE = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 0 WHEN {0} <= 0.1 THEN {0} * 100 WHEN {0} <= 0.25 THEN 10 + ({0} - 0.1) / 0.15 * 25 WHEN {0} <= 0.5 THEN 35 + ({0} - 0.25) / 0.25 * 35 ELSE least(100, 70 + ({0} - 0.5) / 0.5 * 30) END"
SQL_EXPOSURE = f"""{SQL_FLOWS}, exposure AS (SELECT source, year, sum(amount) AS total, sum(amount) FILTER (target = source) AS own, sum(amount) FILTER (target <> source AND t.n_regionkey = s.n_regionkey) AS group_, sum(amount) FILTER (t.n_regionkey <> s.n_regionkey) AS outside
  FROM flows JOIN nation s ON s.n_nationkey = source JOIN nation t ON t.n_nationkey = target GROUP BY ALL)"""


def exposure(spark: SparkSession, d: str) -> DataFrame:
    region = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    f = flows(spark, d).join(F.broadcast(region.toDF("source", "home")), "source").join(F.broadcast(region.toDF("target", "abroad")), "target")
    part = lambda c: F.sum(F.when(c, F.col("amount")))
    same = F.col("source") == F.col("target")
    return f.groupBy("source", "year").agg(F.sum("amount").alias("total"), part(same).alias("own"), part(~same & (F.col("home") == F.col("abroad"))).alias("group_"), part(F.col("home") != F.col("abroad")).alias("outside"))


@query("exposure_ratios", f"""WITH {SQL_EXPOSURE} SELECT source, year, round(own / total, 6) AS own, round(group_ / total, 6) AS in_group, round(outside / total, 6) AS outside, round({_SCORE.format("(group_ / total)")}, 4) AS score,
  round(0.6 * {_SCORE.format("(group_ / total)")} + 0.4 * {_SCORE.format("(own / total)")}, 4) AS mixed FROM exposure""")
def exposure_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by how near the other side is, over all of a source and year; a non-linear score, and a mix of two."""
    x = exposure(spark, d)
    share = lambda c: F.col(c) / F.col("total")
    return x.select(
        "source", "year", r6(share("own")).alias("own"), r6(share("group_")).alias("in_group"), r6(share("outside")).alias("outside"), F.round(exposure_score(share("group_")), 4).alias("score"),
        F.round(0.6 * exposure_score(share("group_")) + 0.4 * exposure_score(share("own")), 4).alias("mixed"),
    )


@query("temporal_risk", f"""WITH {SQL_EXPOSURE}, s AS (SELECT source, year, group_ / total AS share, lag(group_ / total) OVER w AS share1, total / nullif(lag(total) OVER w, 0) - 1 AS growth, lag(year) OVER w AS year1 FROM exposure WINDOW w AS (PARTITION BY source ORDER BY year))
SELECT source, year, round(share - share1, 6) AS change, round(growth, 6) AS growth, CASE WHEN share1 IS NULL OR year <> year1 + 1 THEN 'NEW' WHEN share - share1 > 0.05 AND growth > 0 THEN 'RISING' WHEN share - share1 < -0.05 THEN 'FALLING' ELSE 'STEADY' END AS trend FROM s""")
def temporal_risk(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("year")
    s = exposure(spark, d).withColumn("share", F.col("group_") / F.col("total"))
    s = s.withColumns({"share1": F.lag("share").over(w), "growth": F.try_divide("total", F.lag("total").over(w)) - 1, "year1": F.lag("year").over(w)})
    change = F.col("share") - F.col("share1")
    trend = F.when(F.col("share1").isNull() | (F.col("year") != F.col("year1") + 1), "NEW").when((change > 0.05) & (F.col("growth") > 0), "RISING").when(change < -0.05, "FALLING").otherwise("STEADY")
    return s.select("source", "year", r6(change).alias("change"), r6("growth").alias("growth"), trend.alias("trend"))


@query(
    "graph_slices",
    f"""WITH {SQL_RELATIONS}, d AS (SELECT k, period, sum(o) AS out_degree, sum(i) AS in_degree, sum(net) AS net FROM (SELECT source AS k, period, 1 AS o, 0 AS i, -amount AS net FROM edges UNION ALL SELECT target, period, 0, 1, amount FROM edges) GROUP BY ALL)
SELECT k AS entity, period, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree AS BIGINT) AS in_degree, round(net, 4) AS net, round(sum(net) OVER (PARTITION BY k ORDER BY period), 4) AS so_far FROM d""",
    dates=("period",),
)
def graph_slices(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's edges and balance by period, and the balance so far."""
    r = written(flow_edges(spark, d))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = r.select(F.col("source").alias("entity"), "period", one.alias("o"), none.alias("i"), (-F.col("amount")).alias("net")).unionByName(r.select(F.col("target").alias("entity"), "period", none.alias("o"), one.alias("i"), F.col("amount").alias("net")))
    g = sides.groupBy("entity", "period").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("net").alias("net"))
    total = F.sum("net").over(Window.partitionBy("entity").orderBy("period"))
    return g.select("entity", "period", "out_degree", "in_degree", F.round("net", 4).alias("net"), F.round(total, 4).alias("so_far"))

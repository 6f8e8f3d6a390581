"""Joins, set operations, orders, scalars and upserts of the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import series
from marketloom.functions.text import ACCENTED, PLAIN, fold_letters
from marketloom.functions.ranks import dealt_rank
from marketloom.operators.relational import asof_backward, range_or_null
from marketloom.plans.catalog import query
from marketloom.plans.risk import RETURNS, r6, returns
from marketloom.sources.tables import SQL_BARS, SQL_FLOWS, SQL_STOCKS, bars, flows, load, stocks


@query("keyword_filter", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%' OR p_type ILIKE 'eco%'")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").filter(F.col("p_name").ilike("%WIDGET%") | F.col("p_type").ilike("eco%")).select("p_partkey", "p_name")


@query("left_outer_flows", f"WITH {SQL_FLOWS} SELECT n_nationkey, year, round(coalesce(amount, 0), 2) AS amount FROM nation LEFT JOIN flows ON source = n_nationkey AND target = 0")
def left_outer_flows(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).filter("target = 0").select("source", "year", "amount")
    n = load(spark, d, "nation").select("n_nationkey")
    return n.join(f, F.col("n_nationkey") == F.col("source"), "left").select("n_nationkey", "year", F.round(F.coalesce("amount", F.lit(0.0)), 2).alias("amount"))


@query("lateral_exact_key", f"WITH {SQL_BARS}, m AS (SELECT max(date) AS date FROM bars) SELECT s_suppkey, (SELECT round(close, 6) FROM bars, m WHERE bars.date = m.date AND symbol = s_suppkey) AS close FROM supplier")
def lateral_exact_key(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    last = b.join(F.broadcast(b.agg(F.max("date").alias("date"))), "date").select("symbol", "close")
    return load(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("symbol"), "left").select("s_suppkey", r6("close").alias("close"))


@query("asof_aligned_fundamentals", f"""WITH {SQL_BARS}, q AS (SELECT o_custkey % 10 AS symbol, CAST(o_orderdate AS DATE) + CASE quarter(o_orderdate) WHEN 2 THEN 55 WHEN 4 THEN 35 ELSE 45 END AS known, avg(o_totalprice) AS ratio FROM orders GROUP BY ALL)
SELECT b.symbol, b.date, round(q.ratio, 6) AS ratio, q.known FROM bars b ASOF LEFT JOIN q ON q.symbol = b.symbol AND b.date >= q.known""", dates=("date", "known"))
def asof_aligned_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    """Each bar with the last figures that were known by then."""
    day = F.col("o_orderdate").cast("date")
    lag = F.when(F.quarter(day) == 2, 55).when(F.quarter(day) == 4, 35).otherwise(45)
    q = load(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("symbol"), F.date_add(day, lag).alias("date")).agg(F.avg("o_totalprice").alias("ratio"))
    out = asof_backward(bars(spark, d).select("symbol", "date", "close"), q, ["symbol"], "date", {"ratio": "ratio", "date": "known"})
    return out.select("symbol", "date", r6("ratio").alias("ratio"), "known")


@query("cast_key_join", "SELECT o_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON CAST(o_orderkey AS VARCHAR) = CAST(l_orderkey AS VARCHAR) GROUP BY o_orderkey")
def cast_key_join(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), "l_extendedprice")
    return o.join(l, "k").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("unnest_lateral", """WITH w AS (SELECT n_nationkey AS list, unnest([n_nationkey, n_nationkey + 1, n_nationkey + 1000]) AS user_id FROM nation), q AS (SELECT user_id, arg_max(value, (ts, event_id)) AS price FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT list, user_id, round(price, 6) AS price FROM w LEFT JOIN q USING (user_id)""")
def unnest_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of each symbol of each list; a symbol without one stays."""
    n = F.col("n_nationkey").cast("long")
    w = load(spark, d, "nation").select(F.col("n_nationkey").alias("list"), F.explode(F.array(n, n + 1, n + 1000)).alias("user_id"))
    q = load(spark, d, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    return w.join(q, "user_id", "left").select("list", "user_id", r6("price").alias("price"))


_FACTORS = {"size": "p_size", "price": "p_retailprice", "name": "length(p_name)", "ratio": "p_retailprice / p_size"}


@query("correlation_matrix", f"""WITH v AS (SELECT p_partkey, unnest([{", ".join(f"'{k}'" for k in _FACTORS)}]) AS factor, unnest([{", ".join(f"CAST({v} AS DOUBLE)" for v in _FACTORS.values())}]) AS x FROM part),
r AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY x) + (count(*) OVER (PARTITION BY factor, x) - 1) / 2 AS k FROM v)
SELECT a.factor AS one, b.factor AS two, round(corr(a.x, b.x), 6) AS pearson, round(corr(a.k, b.k), 6) AS spearman, abs(corr(a.k, b.k)) > 0.7 AS collinear FROM r a JOIN r b USING (p_partkey) WHERE a.factor < b.factor GROUP BY ALL""")
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Plain and rank correlation of each pair of factors; factors are few, rows are not, so pairs are columns of one aggregate."""
    p = load(spark, d, "part").select("p_partkey", *[F.expr(v).cast("double").alias(k) for k, v in _FACTORS.items()])
    long = p.select("p_partkey", F.explode(F.create_map(*[x for k in _FACTORS for x in (F.lit(k), F.col(k))])).alias("factor", "x"))
    ranks = dealt_rank(long, "x", "factor", "k")
    wide = ranks.groupBy("p_partkey").agg(*[F.max(F.when(F.col("factor") == k, F.col(c))).alias(f"{c}_{k}") for k in _FACTORS for c in ("x", "k")])
    names = sorted(_FACTORS)
    pairs = [F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.corr(f"x_{a}", f"x_{b}").alias("p"), F.corr(f"k_{a}", f"k_{b}").alias("s")) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = wide.agg(F.array(*pairs).alias("pairs")).select(F.explode("pairs").alias("c"))
    return out.select("c.one", "c.two", r6("c.p").alias("pearson"), r6("c.s").alias("spearman"), (F.abs("c.s") > 0.7).alias("collinear"))


@query("liquidity_top10", f"WITH {SQL_BARS}, l AS (SELECT symbol, sum(volume * close) AS value, count(*) FILTER (close > open) AS up, count(*) FILTER (close < open) AS down FROM bars GROUP BY symbol) SELECT symbol, round(value, 2) AS value, up, down FROM l ORDER BY value DESC, symbol LIMIT 10")
def liquidity_top10(spark: SparkSession, d: str) -> DataFrame:
    l = bars(spark, d).groupBy("symbol").agg(F.sum(F.col("volume") * F.col("close")).alias("value"), F.count_if(F.col("close") > F.col("open")).alias("up"), F.count_if(F.col("close") < F.col("open")).alias("down"))
    return l.orderBy(F.desc("value"), "symbol").limit(10).withColumn("value", F.round("value", 2))


@query("xs_median", RETURNS + " SELECT date, count(r) AS n, round(median(r), 6) AS median, round(median(volume), 6) AS volume FROM ret GROUP BY date", dates=("date",))
def xs_median(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).groupBy("date").agg(F.count("r").alias("n"), r6(F.median("r")).alias("median"), r6(F.median("volume")).alias("volume"))


@query("streak_from_latest", f"""WITH {SQL_BARS}, x AS (SELECT symbol, close > open AS up, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) SELECT symbol, coalesce(min(n) FILTER (NOT up) - 1, count(*)) AS streak FROM x GROUP BY symbol""")
def streak_from_latest(spark: SparkSession, d: str) -> DataFrame:
    """How many of the last bars in a row rose."""
    x = bars(spark, d).select("symbol", (F.col("close") > F.col("open")).alias("up"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("n"))
    return x.groupBy("symbol").agg(F.coalesce(F.min(F.when(~F.col("up"), F.col("n"))) - 1, F.count(F.lit(1))).cast("long").alias("streak"))


@query("fill_both_ways", f"""WITH {SQL_BARS}, g AS (SELECT symbol, date, CASE WHEN volume > 100 THEN close END AS x FROM bars)
SELECT symbol, date, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled, x IS NULL AS made FROM g""", dates=("date",))
def fill_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Gaps take the value before them, those at the start the first one after."""
    w = series("symbol", "date")
    g = bars(spark, d).select("symbol", "date", F.when(F.col("volume") > 100, F.col("close")).alias("x"))
    filled = F.coalesce(F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return g.select("symbol", "date", r6(filled).alias("filled"), F.col("x").isNull().alias("made"))


@query("order_nulls_last", "WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cap FROM supplier) SELECT s_suppkey, row_number() OVER (ORDER BY cap DESC NULLS LAST, s_nationkey, s_suppkey) AS place FROM s ORDER BY place LIMIT 50")
def order_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").withColumn("cap", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    order = [F.desc_nulls_last("cap"), F.col("s_nationkey"), F.col("s_suppkey")]
    top = s.orderBy(*order).limit(50)
    return top.select("s_suppkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("topk_tie_break", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 25")
def topk_tie_break(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_size")


@query("overfetch_rerank", "WITH top AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40) SELECT p_partkey, round(p_retailprice / 100 - p_size, 4) AS score FROM top ORDER BY p_retailprice / 100 - p_size DESC, p_partkey LIMIT 10")
def overfetch_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Four times as many as wanted by a cheap score, then the best of them by another."""
    top = load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)
    score = F.col("p_retailprice") / 100 - F.col("p_size")
    return top.orderBy(score.desc(), "p_partkey").limit(10).select("p_partkey", F.round(score, 4).alias("score"))


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT 99")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.union(load(spark, d, "supplier").select("s_nationkey")).union(spark.range(1).select(F.lit(99))).distinct()


@query("intersect_except", """SELECT 'both' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)
UNION ALL SELECT 'first' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150 EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)""")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").filter("value > 150")
    a, b = (e.filter(F.col("event_type") == t).select("user_id") for t in ("purchase", "error"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "user_id").unionByName(a.exceptAll(b).distinct().join(b, "user_id", "left_anti").select(F.lit("first").alias("kind"), "user_id"))


@query("piecewise_cash", "WITH s AS (SELECT s_suppkey, abs(s_acctbal) / 10000 AS v FROM supplier) SELECT s_suppkey, round(CASE WHEN v < 0.2 THEN 10 WHEN v < 0.5 THEN 10 + (v - 0.2) / 0.3 * 40 WHEN v < 0.8 THEN 50 + (v - 0.5) / 0.3 * 30 ELSE 80 END, 4) AS cash FROM s")
def piecewise_cash(spark: SparkSession, d: str) -> DataFrame:
    v = F.abs("s_acctbal") / 10000
    cash = F.when(v < 0.2, 10.0).when(v < 0.5, 10 + (v - 0.2) / 0.3 * 40).when(v < 0.8, 50 + (v - 0.5) / 0.3 * 30).otherwise(80.0)
    return load(spark, d, "supplier").select("s_suppkey", F.round(cash, 4).alias("cash"))


@query("string_fold", f"SELECT doc_id, md5(translate(lower(trim(coalesce(text, ''))), '{ACCENTED}', '{PLAIN}')) AS folded FROM documents")
def string_fold(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.md5(fold_letters(F.coalesce("text", F.lit("")))).alias("folded"))


@query("hash_chain", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, sha256(event_id || '|' || event_type || '|' || coalesce(props, '')) AS own FROM events),
c AS (SELECT user_id, event_id, n, sha256('' || own) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, sha256(c.hash || e.own) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, max(n) AS entries, arg_max(hash, n) AS head FROM c GROUP BY user_id""")
def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    """The head of each log's chain, in which a hash covers the one before it: a fold over the log's own hashes."""
    own = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit(""))), 256)
    log = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list(F.struct("ts", "event_id", own.alias("own")))).alias("log"))
    return log.select("user_id", "entries", F.aggregate("log", F.lit(""), lambda h, e: F.sha2(F.concat(h, e["own"]), 256)).alias("head"))


@query("json_patch", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(json_merge_patch(props, '{"source":"etl","k":' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || '}'), '$.k') AS patched, json_extract_string(json_merge_patch(props, '{"source":"etl"}'), '$.source') AS source FROM events WHERE props IS NOT NULL""")
def json_patch(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a JSON object replaced and added by a patch's."""
    e = load(spark, d, "events").filter("props IS NOT NULL").select("event_id", F.from_json("props", "map<string,string>").alias("old"))
    k = F.col("old")["k"].cast("long")
    patch = F.create_map(F.lit("source"), F.lit("etl"), F.lit("k"), (k + 1).cast("string"))
    kept = F.map_filter("old", lambda name, _: ~name.isin("source", "k"))
    e = e.withColumn("new", F.map_concat(kept, patch))
    return e.select("event_id", k.alias("k"), F.col("new")["k"].alias("patched"), F.col("new")["source"].alias("source"))


@query("richness_upsert", """WITH r AS (SELECT user_id, event_id, [event_type, CASE WHEN value > 50 THEN CAST(round(value, 2) AS VARCHAR) END, CASE WHEN event_id % 3 = 0 THEN props END] AS items FROM events), n AS (SELECT user_id, event_id, len(list_filter(items, lambda x: x IS NOT NULL)) AS filled FROM r)
SELECT user_id, event_id, filled FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY filled DESC, event_id) = 1""")
def richness_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A statement gives way only to one with more items filled; the first of equally rich ones stays."""
    filled = F.size(F.filter(F.array("event_type", F.when(F.col("value") > 50, F.round("value", 2).cast("string")), F.when(F.col("event_id") % 3 == 0, F.col("props"))), lambda x: x.isNotNull())).cast("long")
    n = load(spark, d, "events").select("user_id", filled.alias("filled"), "event_id")
    best = n.groupBy("user_id").agg(F.max(F.struct("filled", (-F.col("event_id")).alias("low"))).alias("b"))
    return best.select("user_id", (-F.col("b.low")).alias("event_id"), "b.filled")


KEYWORDS = (("widget", "hardware"), ("cold", "cooling"), ("gear", "mechanics"))


@query("keyword_map", f"SELECT p_partkey, CASE {' '.join(f'''WHEN contains(lower(p_name), '{k}') THEN '{v}' ''' for k, v in KEYWORDS)} ELSE 'other' END AS family FROM part")
def keyword_map(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword in the map's order that a name holds."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in KEYWORDS])
    hit = F.filter(entries, lambda e: F.lower("p_name").contains(e["k"]))
    return load(spark, d, "part").select("p_partkey", F.coalesce(F.get(hit, F.lit(0))["v"], F.lit("other")).alias("family"))


@query("array_members", """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS states, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS prices FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_contains(states, 'F') AS finished, len(states) AS states, round(prices[1], 2) AS first_price, round(prices[-1], 2) AS last_price, len(prices) AS orders FROM a""")
def array_members(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    a = o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.min_by("o_totalprice", at).alias("first_price"), F.max_by("o_totalprice", at).alias("last_price"), F.count(F.lit(1)).alias("orders"))
    return a.select("o_custkey", F.array_contains("s", "F").alias("finished"), F.size("s").cast("long").alias("states"), F.round("first_price", 2).alias("first_price"), F.round("last_price", 2).alias("last_price"), "orders")


@query("finite_or_null", "WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'NaN' WHEN 2 THEN 'n/a' ELSE 'Infinity' END AS raw FROM events), c AS (SELECT event_id, try_cast(raw AS DOUBLE) AS x FROM v) SELECT event_id, CASE WHEN isfinite(x) THEN x END AS value FROM c")
def finite_or_null(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.col("value").cast("string")).when(i == 1, "NaN").when(i == 2, "n/a").otherwise("Infinity")
    x = raw.try_cast("double")
    return load(spark, d, "events").select("event_id", F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias("value"))


@query("universe_classes", f"""WITH {SQL_BARS}, {SQL_STOCKS}, a AS (SELECT symbol, avg(volume * close) AS adtv, count(*) AS bars, count(*) FILTER (volume < 20) AS thin FROM bars GROUP BY symbol), k AS (SELECT symbol, market_cap, adtv, bars, thin, rank() OVER (ORDER BY market_cap DESC NULLS LAST) AS place FROM stocks LEFT JOIN a USING (symbol))
SELECT symbol, CASE WHEN adtv IS NULL OR market_cap IS NULL THEN 'EXCLUDED' WHEN thin > 0.2 * bars THEN 'EXCLUDED' WHEN place <= 5 AND adtv > 1e6 THEN 'BLUE_CHIP' WHEN adtv > 5e5 THEN 'CORE' ELSE 'SANDBOX' END AS class FROM k""")
def universe_classes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by liquidity, size and gaps; the first rule that fits."""
    a = bars(spark, d).groupBy("symbol").agg(F.avg(F.col("volume") * F.col("close")).alias("adtv"), F.count(F.lit(1)).alias("bars"), F.count_if(F.col("volume") < 20).alias("thin"))
    s = stocks(spark, d)
    top = s.orderBy(F.desc_nulls_last("market_cap"), "symbol").limit(5).select("symbol", F.lit(True).alias("large"))
    k = s.join(a, "symbol", "left").join(F.broadcast(top), "symbol", "left")
    kind = F.when(F.col("adtv").isNull() | F.col("market_cap").isNull() | (F.col("thin") > 0.2 * F.col("bars")), "EXCLUDED").when(F.col("large") & (F.col("adtv") > 1e6), "BLUE_CHIP").when(F.col("adtv") > 5e5, "CORE").otherwise("SANDBOX")
    return k.select("symbol", kind.alias("class"))


@query("real_symbols", "SELECT s_suppkey, regexp_matches(s_name, '^Supplier#[0-9]{9}$') AND NOT regexp_matches(s_name, '[05]$') AS real FROM supplier")
def real_symbols(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select("s_suppkey", (F.col("s_name").rlike("^Supplier#[0-9]{9}$") & ~F.col("s_name").rlike("[05]$")).alias("real"))


#: Presets of the screener: name, least and most of each measure.
PRESETS = (("value", {"ratio": (None, 60.0), "cap": (1000.0, None)}), ("momentum", {"gain": (0.1, None)}), ("anything", {}))


def _bounds_sql(filters: dict) -> str:
    out = [f"{c} IS NOT NULL" + (f" AND {c} >= {lo}" if lo is not None else "") + (f" AND {c} <= {hi}" if hi is not None else "") for c, (lo, hi) in filters.items()]
    return " AND ".join(out) or "true"


_SCREEN = f"""WITH {SQL_BARS}, {SQL_STOCKS}, l AS (SELECT symbol, arg_max(close, date) AS close, arg_max(close, date) / arg_max(close, date) FILTER (date < (SELECT max(date) FROM bars)) - 1 AS gain FROM bars GROUP BY symbol),
f AS (SELECT s_suppkey AS symbol, avg(p_retailprice / p_size) AS ratio FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1), j AS (SELECT stocks.symbol, sector, market_cap AS cap, close, gain, ratio FROM stocks LEFT JOIN l USING (symbol) LEFT JOIN f USING (symbol))"""


@query("screener_presets", _SCREEN + " " + " UNION ALL ".join(f"(SELECT '{n}' AS preset, symbol, round(close, 4) AS close, count(*) OVER () AS total FROM j WHERE {_bounds_sql(b)} ORDER BY cap DESC NULLS LAST, symbol LIMIT 20 OFFSET 1)" for n, b in PRESETS))
def screener_presets(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot, ratios and indicators joined, then filtered, ordered and paged by each preset; the total is that before paging."""
    b = bars(spark, d)
    last = F.broadcast(b.agg(F.max("date").alias("last")))
    l = b.crossJoin(last).groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max_by("close", F.when(F.col("date") < F.col("last"), F.col("date"))).alias("before"))
    l = l.select("symbol", "close", (F.col("close") / F.col("before") - 1).alias("gain"))
    f = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("symbol")).agg(F.avg(F.col("p_retailprice") / F.col("p_size")).alias("ratio"))
    j = stocks(spark, d).withColumnRenamed("market_cap", "cap").join(l, "symbol", "left").join(f, "symbol", "left")
    out = None
    for name, filters in PRESETS:
        keep = F.lit(True)
        for c, (lo, hi) in filters.items():
            keep = keep & range_or_null(F.col(c), lo, hi)
        fit = j.filter(keep)
        page = fit.orderBy(F.desc_nulls_last("cap"), "symbol").offset(1).limit(20).crossJoin(F.broadcast(fit.agg(F.count(F.lit(1)).alias("total"))))
        page = page.select(F.lit(name).alias("preset"), "symbol", F.round("close", 4).alias("close"), "total")
        out = page if out is None else out.unionByName(page)
    return out


@query("board_snapshot", f"""WITH {SQL_BARS}, {SQL_STOCKS}, x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars), m AS (SELECT symbol, max(date) AS date FROM bars GROUP BY symbol), v AS (SELECT s_nationkey, count(*) AS peers FROM supplier GROUP BY 1)
SELECT x.symbol, sector, exchange, x.date, round(x.close, 4) AS close, round(prev, 4) AS prev, round(x.close / nullif(prev, 0) - 1, 6) AS change, round(coalesce(nullif(market_cap, 0), x.close * x.volume), 2) AS cap FROM x JOIN m USING (symbol, date) LEFT JOIN stocks ON stocks.symbol = x.symbol""", dates=("date",))
def board_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The last bar of each symbol with the close before it and what is known of the symbol."""
    b = bars(spark, d).withColumn("prev", F.lag("close").over(series("symbol", "date")))
    l = b.groupBy("symbol").agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in ("close", "prev", "volume")])
    j = l.join(stocks(spark, d), "symbol", "left")
    return j.select("symbol", "sector", "exchange", "date", F.round("close", 4).alias("close"), F.round("prev", 4).alias("prev"), r6(F.try_divide("close", "prev") - 1).alias("change"), F.round(F.coalesce(F.expr("nullif(market_cap, 0)"), F.col("close") * F.col("volume")), 2).alias("cap"))


@query("index_snapshot", """WITH b AS (SELECT o_orderpriority AS name, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS level FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day DESC) AS n FROM b)
SELECT name, max(day) FILTER (n = 1) AS day, round(max(level) FILTER (n = 1), 2) AS level, round(max(level) FILTER (n = 2), 2) AS prev, round(max(level) FILTER (n = 1) / max(level) FILTER (n = 2) - 1, 6) AS change FROM r WHERE n <= 2 GROUP BY name""", dates=("day",))
def index_snapshot(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("level"))
    r = b.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("day")))).filter("n <= 2")
    at = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    return r.groupBy("name").agg(at(1, "day").alias("day"), F.round(at(1, "level"), 2).alias("level"), F.round(at(2, "level"), 2).alias("prev"), r6(at(1, "level") / at(2, "level") - 1).alias("change"))


@query("price_drift", f"""WITH {SQL_BARS}, x AS (SELECT symbol, date, close, open, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars)
SELECT symbol, date, round(open / prev - 1, 6) AS gap, CASE WHEN abs(open / prev - 1) > 0.5 THEN 'REBUILD' WHEN abs(open / prev - 1) > 0.2 THEN 'CHECK' ELSE 'OK' END AS action FROM x WHERE prev > 0""", dates=("date",))
def price_drift(spark: SparkSession, d: str) -> DataFrame:
    """Jumps between a close and the next open that an adjustment missed."""
    x = bars(spark, d).withColumn("prev", F.lag("close").over(series("symbol", "date"))).filter("prev > 0")
    gap = F.col("open") / F.col("prev") - 1
    return x.select("symbol", "date", r6(gap).alias("gap"), F.when(F.abs(gap) > 0.5, "REBUILD").when(F.abs(gap) > 0.2, "CHECK").otherwise("OK").alias("action"))


@query("order_book_snapshots", """WITH l AS (SELECT l_orderkey AS book, CASE WHEN l_returnflag = 'R' THEN 'ask' ELSE 'bid' END AS side, l_extendedprice / l_quantity AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)
SELECT book, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, round(max(price) FILTER (side = 'bid'), 7) AS best_bid, round(min(price) FILTER (side = 'ask'), 7) AS best_ask, array_to_string(list(CAST(floor(price) AS BIGINT) ORDER BY price DESC) FILTER (side = 'bid'), '|') AS ladder FROM l GROUP BY book""")
def order_book_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The two sides of each book as ordered arrays of levels."""
    side = F.when(F.col("l_returnflag") == "R", "ask").otherwise("bid")
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book"), side.alias("side"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")).agg(F.sum("l_quantity").alias("volume"))
    level = F.struct((-F.col("price")).alias("order"), "price", "volume")
    b = l.groupBy("book").agg(F.array_sort(F.collect_list(F.when(F.col("side") == "bid", level))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"), F.count_if(F.col("side") == "ask").alias("asks"))
    ladder = F.array_join(F.transform("bid", lambda x: F.floor(x["price"]).cast("string")), "|")
    return b.select("book", F.size("bid").cast("long").alias("bids"), "asks", F.round(F.get("bid", F.lit(0))["price"], 7).alias("best_bid"), F.round("best_ask", 7).alias("best_ask"), F.when(F.size("bid") > 0, ladder).alias("ladder"))

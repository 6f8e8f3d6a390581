"""Rules over positions, models and statements: ladders of conditions in which the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.frames import last_n, series, true_range
from marketloom.plans.catalog import query
from marketloom.plans.factors import SQL_STATEMENTS, latest_statements
from marketloom.plans.risk import RETURNS, r6, returns
from marketloom.plans.trading import NAV
from marketloom.sources.tables import SQL_BARS, SQL_STOCKS, bars, load, stocks


@query("position_rules", f"""WITH {SQL_BARS}, x AS (SELECT symbol, date, close, volume, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS adtv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
a AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))
SELECT symbol, date, round(greatest(close - 2 * atr, close * 0.93), 4) AS stop, round(close + 3 * atr, 4) AS target, CAST(floor(least(0.01 * {NAV} / nullif(close - greatest(close - 2 * atr, close * 0.93), 0), 0.15 * {NAV} / close, 0.1 * adtv * 20)) AS BIGINT) AS shares, round(least(1.0, 0.15 / nullif(atr / close * sqrt(12), 0)), 6) AS scaled FROM a WHERE atr > 0""", dates=("date",))
def position_rules(spark: SparkSession, d: str) -> DataFrame:
    """Stop, target and size by the range: one hundredth of net value at risk, caps by weight and volume, and the part that a target volatility leaves."""
    w = series("symbol", "date")
    x = bars(spark, d).withColumn("tr", F.when(F.lag("close").over(w).isNotNull(), true_range(F.col("high"), F.col("low"), F.col("close"), w)).otherwise(F.col("high") - F.col("low")))
    w14, c = last_n(w, 14), F.col("close")
    x = x.withColumns({"atr": F.when(F.count("tr").over(w14) == 14, F.avg("tr").over(w14)), "adtv": F.avg("volume").over(last_n(w, 20))}).filter("atr > 0")
    stop = F.greatest(c - 2 * F.col("atr"), c * 0.93)
    shares = F.floor(F.least(F.try_divide(F.lit(0.01 * NAV), c - stop), 0.15 * NAV / c, 0.1 * F.col("adtv") * 20))
    return x.select("symbol", "date", F.round(stop, 4).alias("stop"), F.round(c + 3 * F.col("atr"), 4).alias("target"), shares.cast("long").alias("shares"), r6(F.least(F.lit(1.0), F.try_divide(F.lit(0.15), F.col("atr") / c * F.sqrt(F.lit(12.0))))).alias("scaled"))


@query("forensic_gate", f"""WITH {SQL_STATEMENTS}, f AS (SELECT symbol, (gross4 / nullif(revenue4, 0)) / nullif(gross / nullif(revenue, 0), 0) AS gmi, revenue / nullif(revenue4, 0) AS sgi, (income - cash_flow) / nullif(assets, 0) AS accruals, ((assets - equity) / nullif(assets, 0)) / nullif(debt4 / nullif(assets4, 0), 0) AS lvgi FROM latest),
m AS (SELECT *, -4.84 + 0.528 * greatest(0.1, least(10, coalesce(gmi, 1))) + 0.892 * greatest(0.1, least(10, coalesce(sgi, 1))) + 4.679 * coalesce(accruals, 0) - 0.327 * greatest(0.1, least(10, coalesce(lvgi, 1))) + 0.92 + 0.404 + 0.115 - 0.172 AS score FROM f)
SELECT symbol, round(score, 6) AS score, gmi IS NULL OR sgi IS NULL AS partial, CASE WHEN gmi IS NULL AND sgi IS NULL THEN 'UNKNOWN' WHEN score > -1.78 THEN 'BLOCK' WHEN score > -2.22 THEN 'REVIEW' ELSE 'CLEAR' END AS gate FROM m""")
def forensic_gate(spark: SparkSession, d: str) -> DataFrame:
    """The manipulation score with ratios kept within 0.1 and 10, those that no item gives at 1, and what it allows."""
    x = latest_statements(spark, d)
    div = F.try_divide
    f = x.select("symbol", div(div("gross4", "revenue4"), div("gross", "revenue")).alias("gmi"), div("revenue", "revenue4").alias("sgi"), div(F.col("income") - F.col("cash_flow"), F.col("assets")).alias("accruals"), div(div(F.col("assets") - F.col("equity"), F.col("assets")), div("debt4", "assets4")).alias("lvgi"))
    kept = lambda c: F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.coalesce(c, F.lit(1.0))))
    score = -4.84 + 0.528 * kept("gmi") + 0.892 * kept("sgi") + 4.679 * F.coalesce("accruals", F.lit(0.0)) - 0.327 * kept("lvgi") + 0.92 + 0.404 + 0.115 - 0.172
    f = f.withColumn("score", score)
    gate = F.when(F.col("gmi").isNull() & F.col("sgi").isNull(), "UNKNOWN").when(F.col("score") > -1.78, "BLOCK").when(F.col("score") > -2.22, "REVIEW").otherwise("CLEAR")
    return f.select("symbol", r6("score").alias("score"), (F.col("gmi").isNull() | F.col("sgi").isNull()).alias("partial"), gate.alias("gate"))


@query("model_health", RETURNS + """, s AS (SELECT symbol, date, r, lag(r) OVER (PARTITION BY symbol ORDER BY date) > 0 AS said FROM ret), h AS (SELECT symbol, date, avg(CASE WHEN said = (r > 0) THEN 1.0 ELSE 0 END) OVER w AS hit, avg(CASE WHEN said THEN r ELSE -r END) OVER w AS edge, count(said) OVER w AS n FROM s WHERE said IS NOT NULL AND r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
SELECT symbol, date, round(hit, 6) AS hit, round(edge, 6) AS edge, CASE WHEN n < 20 THEN 'LEARNING' WHEN hit < 0.4 AND edge < 0 THEN 'SUSPENDED' WHEN hit < 0.5 OR edge < 0 THEN 'REDUCED' ELSE 'HEALTHY' END AS state, CASE WHEN n < 20 THEN 0.5 WHEN hit < 0.4 AND edge < 0 THEN 0 WHEN hit < 0.5 OR edge < 0 THEN 0.5 ELSE 1 END AS scale FROM h""", dates=("date",))
def model_health(spark: SparkSession, d: str) -> DataFrame:
    """How the last twenty signals fared, and how much of a position a model may still take."""
    w = series("symbol", "date")
    s = returns(spark, d).withColumn("said", F.lag("r").over(w) > 0).filter("said IS NOT NULL AND r IS NOT NULL")
    w20, r = last_n(w, 20), F.col("r")
    h = s.select("symbol", "date", F.avg(F.when(F.col("said") == (r > 0), 1.0).otherwise(0.0)).over(w20).alias("hit"), F.avg(F.when(F.col("said"), r).otherwise(-r)).over(w20).alias("edge"), F.count("said").over(w20).alias("n"))
    few, bad, poor = F.col("n") < 20, (F.col("hit") < 0.4) & (F.col("edge") < 0), (F.col("hit") < 0.5) | (F.col("edge") < 0)
    return h.select("symbol", "date", r6("hit").alias("hit"), r6("edge").alias("edge"), F.when(few, "LEARNING").when(bad, "SUSPENDED").when(poor, "REDUCED").otherwise("HEALTHY").alias("state"), F.when(few, 0.5).when(bad, 0.0).when(poor, 0.5).otherwise(1.0).alias("scale"))


@query("eligibility", f"""{RETURNS}, {SQL_STOCKS}, a AS (SELECT symbol, avg(volume * close) AS adtv, count(*) AS n, stddev_samp(r) AS vol, max(date) AS last FROM ret GROUP BY symbol), m AS (SELECT max(last) AS last FROM a)
SELECT s.symbol, CASE WHEN a.n IS NULL OR a.n < 60 THEN 'SHORT_HISTORY' WHEN a.last < m.last THEN 'STALE' WHEN adtv < 2e5 THEN 'ILLIQUID' WHEN vol > 4 THEN 'TOO_VOLATILE' WHEN market_cap IS NULL THEN 'NO_CAPITAL' ELSE 'ELIGIBLE' END AS verdict, round(2e4 / nullif(adtv, 0), 6) AS days_to_exit, CAST(floor(0.15 * adtv) AS BIGINT) AS capacity FROM stocks s LEFT JOIN a USING (symbol), m""")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Why a symbol may not be held, the bars it takes to leave, and what can be held."""
    a = returns(spark, d).groupBy("symbol").agg(F.avg(F.col("volume") * F.col("close")).alias("adtv"), F.count(F.lit(1)).alias("n"), F.stddev_samp("r").alias("vol"), F.max("date").alias("last"))
    m = a.agg(F.max("last").alias("end"))
    x = stocks(spark, d).join(a, "symbol", "left").crossJoin(F.broadcast(m))
    verdict = F.when(F.col("n").isNull() | (F.col("n") < 60), "SHORT_HISTORY").when(F.col("last") < F.col("end"), "STALE").when(F.col("adtv") < 2e5, "ILLIQUID").when(F.col("vol") > 4, "TOO_VOLATILE").when(F.col("market_cap").isNull(), "NO_CAPITAL").otherwise("ELIGIBLE")
    return x.select("symbol", verdict.alias("verdict"), r6(F.try_divide(F.lit(2e4), F.col("adtv"))).alias("days_to_exit"), F.floor(0.15 * F.col("adtv")).cast("long").alias("capacity"))


@query("dynamic_allocation", RETURNS + """, m AS (SELECT date, avg(r) AS r FROM ret WHERE r IS NOT NULL GROUP BY date), v AS (SELECT date, r, stddev_samp(r) OVER w * sqrt(12) AS vol, sum(r) OVER (ORDER BY date ROWS 5 PRECEDING) AS trend, count(*) OVER w AS n FROM m WINDOW w AS (ORDER BY date ROWS 11 PRECEDING)),
t AS (SELECT date, greatest(0.2, least(1, 2 / nullif(vol, 0))) * CASE WHEN trend < 0 THEN 0.5 ELSE 1 END AS wanted FROM v WHERE n = 12)
SELECT date, round(wanted, 6) AS wanted, round(1 - wanted, 6) AS cash, coalesce(abs(wanted - lag(wanted) OVER (ORDER BY date)) >= 0.02, true) AS rebalances FROM t""", dates=("date",))
def dynamic_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Exposure by volatility and trend of the market, changed only beyond a band of 2 %. One row a date."""
    m = returns(spark, d).filter("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("r"))
    by = Window.orderBy("date")
    w = by.rowsBetween(-11, 0)
    v = m.select("date", (F.stddev_samp("r").over(w) * F.sqrt(F.lit(12.0))).alias("vol"), F.sum("r").over(by.rowsBetween(-5, 0)).alias("trend"), F.count(F.lit(1)).over(w).alias("n")).filter("n = 12")
    t = v.withColumn("wanted", F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.try_divide(F.lit(2.0), F.col("vol")))) * F.when(F.col("trend") < 0, 0.5).otherwise(1.0))
    return t.select("date", r6("wanted").alias("wanted"), r6(1 - F.col("wanted")).alias("cash"), F.coalesce(F.abs(F.col("wanted") - F.lag("wanted").over(by)) >= 0.02, F.lit(True)).alias("rebalances"))


@query("execution_quality", """WITH l AS (SELECT l_suppkey AS broker, l_extendedprice / l_quantity AS price, l_quantity AS q, CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS way, avg(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey) AS reference, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delay FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT broker, count(*) AS fills, round(sum(way * (price - reference) * q) / sum(reference * q) * 1e4, 4) AS slippage_bp, round(avg(delay), 4) AS delay, round(avg(CASE WHEN way * (price - reference) <= 0 THEN 1.0 ELSE 0 END), 6) AS improved FROM l GROUP BY broker""")
def execution_quality(spark: SparkSession, d: str) -> DataFrame:
    """What brokers paid against the mean price of the same symbol, how late, and how often for the better."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    l = load(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    price, q = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity")
    l = l.select(F.col("l_suppkey").alias("broker"), price.alias("price"), q.alias("q"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("way"), F.avg(price).over(Window.partitionBy("l_partkey")).alias("reference"), F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("delay"))
    gap = F.col("way") * (F.col("price") - F.col("reference"))
    return l.groupBy("broker").agg(F.count(F.lit(1)).alias("fills"), F.round(F.sum(gap * F.col("q")) / F.sum(F.col("reference") * F.col("q")) * 1e4, 4).alias("slippage_bp"), F.round(F.avg("delay"), 4).alias("delay"), r6(F.avg(F.when(gap <= 0, 1.0).otherwise(0.0))).alias("improved"))


@query("ic_decay", RETURNS + f""", k AS (SELECT symbol, date, r, {", ".join(f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS f{h}" for h in (1, 3, 6))} FROM ret), c AS (SELECT date, {", ".join(f"corr(r, f{h}) AS c{h}" for h in (1, 3, 6))} FROM k WHERE r IS NOT NULL AND f6 IS NOT NULL GROUP BY date HAVING count(*) >= 5)
SELECT unnest([1, 3, 6]) AS horizon, unnest([round(avg(c1), 6), round(avg(c3), 6), round(avg(c6), 6)]) AS ic, unnest([round(avg(c1) / stddev_samp(c1), 6), round(avg(c3) / stddev_samp(c3), 6), round(avg(c6) / stddev_samp(c6), 6)]) AS ratio FROM c""")
def ic_decay(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the last return with the next ones over three horizons."""
    w = series("symbol", "date")
    hs = (1, 3, 6)
    k = returns(spark, d).withColumns({f"f{h}": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in hs}).filter("r IS NOT NULL AND f6 IS NOT NULL")
    c = k.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *[F.corr("r", f"f{h}").alias(f"c{h}") for h in hs]).filter("n >= 5")
    one = c.agg(F.array(*[F.struct(F.lit(h).alias("horizon"), F.avg(f"c{h}").alias("ic"), (F.avg(f"c{h}") / F.stddev_samp(f"c{h}")).alias("ratio")) for h in hs]).alias("rows"))
    return one.select(F.explode("rows").alias("r")).select("r.horizon", r6("r.ic").alias("ic"), r6("r.ratio").alias("ratio"))


#: What is tried after byte order marks and UTF-8, in this order: the first whose letters fit well enough.
CANDIDATES = ("windows-1252", "ISO-8859-1")
#: Controls of ISO-8859-1 that no text has; a decoding with any is rejected.
_CONTROLS = "[\\x{80}-\\x{9F}]"


def decoded_text(raw: Column) -> tuple[Column, Column]:
    """The character set of some bytes and the text they are: by byte order mark, UTF-8 if valid, else the first candidate that gives no control characters."""
    head = lambda n: F.hex(F.substring(raw, 1, n))
    rest = lambda n: F.substring(raw, n + 1, 1 << 30)
    valid = F.is_valid_utf8(raw.cast("string"))
    marks = (("EFBBBF", 3, "UTF-8", "utf-8"), ("FFFE", 2, "UTF-16LE", "utf-16le"), ("FEFF", 2, "UTF-16BE", "utf-16be"))
    name, text = None, None
    for mark, n, charset, told in marks:
        fits = head(n) == mark
        name = F.when(fits, told) if name is None else name.when(fits, told)
        text = F.when(fits, F.decode(rest(n), charset)) if text is None else text.when(fits, F.decode(rest(n), charset))
    name, text = name.when(valid, "utf-8"), text.when(valid, raw.cast("string"))
    # Of the single-byte sets the second is told apart by bytes that it has as controls only.
    high = F.hex(raw).rlike("^(?:..)*(?:8|9).")
    return name.when(high, CANDIDATES[0]).otherwise(CANDIDATES[1].lower()), text.when(high, _windows(raw)).otherwise(F.decode(raw, "ISO-8859-1"))


#: Characters of windows-1252 at bytes 80 to 9F (those without one stay as they are).
_WINDOWS = {0x80: "€", 0x85: "…", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x99: "™", 0x9C: "œ", 0x8C: "Œ"}


def _windows(raw: Column) -> Column:
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))


_SINGLE = "regexp_full_match(coalesce(text, ''), '(?s)[\\x00-\\x{FF}]*') AND NOT regexp_matches(coalesce(text, ''), '[\\x{80}-\\x{9F}]') AND regexp_matches(coalesce(text, ''), '[\\x{C0}-\\x{FF}]([^\\x{80}-\\x{BF}]|$)')"


@query(
    "text_decoding",
    f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' WHEN 4 THEN CASE WHEN {_SINGLE} THEN 'iso-8859-1' ELSE 'utf-8' END ELSE CASE WHEN {_SINGLE} THEN 'windows-1252' ELSE 'utf-8' END END AS charset,
  sha256(coalesce(text, '') || CASE WHEN doc_id % 6 = 5 AND {_SINGLE} THEN ' €' ELSE '' END) AS decoded FROM documents""",
)
def text_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Texts of unknown encoding, here as many that have one of six: two with marks, two single-byte sets where a text has their letters only, and UTF-8 with and without a mark."""
    k, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    mark = lambda h: F.unhex(F.lit(h))
    single = text.rlike(r"(?s)\A[\x00-\x{FF}]*\z") & ~text.rlike(_CONTROLS) & text.rlike(r"[\x{C0}-\x{FF}]([^\x{80}-\x{BF}]|\z)")
    one_byte = F.encode(F.when(single, text).otherwise(""), "ISO-8859-1")
    raw = (
        F.when(k == 0, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8"))).when(k == 2, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).when(k == 3, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .when((k == 4) & single, one_byte).when((k == 5) & single, F.concat(one_byte, mark("2080"))).otherwise(F.encode(text, "UTF-8"))
    )
    x = load(spark, d, "documents").select("doc_id", raw.alias("raw"))
    charset, decoded = decoded_text(F.col("raw"))
    return x.select("doc_id", charset.alias("charset"), F.sha2(decoded, 256).alias("decoded"))

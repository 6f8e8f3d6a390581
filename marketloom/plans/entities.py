"""Mentions of products resolved to entities: exact name, alias, name within a text, similar name.

Entities are the products' brand and name; mentions are made from every product row: as
it is, with an underscore, within a sentence, with letters lost or changed over, or of
nothing known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import fuzzy
from marketloom.operators.steps import written
from marketloom.plans.catalog import query
from marketloom.plans.risk import r6
from marketloom.sources.tables import load

#: From which similarity, and for mentions and names of which lengths, a similar name counts.
LEAST, LONGEST, SHORTEST = 0.88, 35, 4
_NAME = "lower(p_brand || ' ' || p_name)"
SQL_MENTIONS = f"""entities AS (SELECT min(p_partkey) AS entity, {_NAME} AS name FROM part GROUP BY {_NAME}), raws AS (SELECT p_partkey, p_size, {_NAME} AS name FROM part),
mentions AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN name WHEN 1 THEN replace(name, ' ', '_') WHEN 2 THEN 'order of ' || name || ' from stock ' || p_size WHEN 3 THEN substr(name, 1, 9) || substr(name, 11)
  WHEN 4 THEN substr(name, 1, 3) || substr(name, 5, 1) || substr(name, 4, 1) || substr(name, 6) ELSE 'nothing known ' || p_size END AS mention FROM raws)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.concat_ws(" ", "p_brand", "p_name"))
    return load(spark, d, "part").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("entity"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    name, k = F.lower(F.concat_ws(" ", "p_brand", "p_name")), F.col("p_partkey") % 6
    cut = lambda i, n=1000: F.substring(name, i, n)
    said: Column = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k == 2, F.concat(F.lit("order of "), name, F.lit(" from stock "), F.col("p_size").cast("string")))
    said = said.when(k == 3, F.concat(cut(1, 9), cut(11))).when(k == 4, F.concat(cut(1, 3), cut(5, 1), cut(4, 1), cut(6))).otherwise(F.concat(F.lit("nothing known "), F.col("p_size").cast("string")))
    return load(spark, d, "part").select("p_partkey", said.alias("mention"))


_SIMILAR = "(1 - levenshtein(mention, name) / greatest(length(mention), length(name)))"


@query("similar_names", f"WITH {SQL_MENTIONS} SELECT mention, name, round({_SIMILAR}, 6) AS similarity FROM (SELECT DISTINCT mention FROM mentions), entities WHERE {_SIMILAR} >= {LEAST} - 1e-9")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a mention and a name that are similar."""
    return fuzzy.similar(mentions(spark, d), entities(spark, d), "mention", "name", LEAST).withColumn("similarity", r6("similarity"))


@query(
    "entity_cascade",
    f"""WITH {SQL_MENTIONS}, f AS (SELECT mention, name, entity, CASE WHEN mention = name THEN 1.0 WHEN replace(mention, '_', ' ') = name THEN 0.98 WHEN contains(' ' || mention || ' ', ' ' || name || ' ') THEN least(0.95, greatest(0.8, 0.75 + 0.2 * length(name) / length(mention)))
  WHEN length(mention) <= {LONGEST} AND length(name) >= {SHORTEST} AND {_SIMILAR} >= {LEAST} - 1e-9 THEN round({_SIMILAR} * 0.9, 2) END AS confidence,
  CASE WHEN mention = name THEN 1 WHEN replace(mention, '_', ' ') = name THEN 2 WHEN contains(' ' || mention || ' ', ' ' || name || ' ') THEN 3 ELSE 4 END AS tier FROM (SELECT DISTINCT mention FROM mentions), entities),
b AS (SELECT * FROM f WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention ORDER BY tier, CASE WHEN tier = 3 THEN length(name) ELSE {_SIMILAR} END DESC, entity) = 1)
SELECT p_partkey, entity, tier, round(confidence, 6) AS confidence FROM mentions LEFT JOIN b USING (mention)""",
)
def entity_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The entity of each mention by the first tier that knows one: its name, an alias, the longest name within it, the most similar name."""
    said, known = written(mentions(spark, d)), written(entities(spark, d))
    texts = said.select("mention").distinct()
    alias = texts.withColumn("name", F.replace("mention", F.lit("_"), F.lit(" "))).join(known.select("name"), "name")
    exact = F.col("mention") == F.col("name")
    tiers = alias.select("mention", "name", F.when(exact, 1).otherwise(2).alias("tier"), F.lit(1.0).alias("rank"), F.when(exact, 1.0).otherwise(0.98).alias("confidence"))
    within = fuzzy.held(texts, known, "mention", "name")
    share = F.length("name") / F.length("mention")
    tiers = tiers.unionByName(within.select("mention", "name", F.lit(3).alias("tier"), F.length("name").cast("double").alias("rank"), F.least(F.lit(0.95), F.greatest(F.lit(0.8), 0.75 + 0.2 * share)).alias("confidence")))
    near = fuzzy.similar(texts.filter(F.length("mention") <= LONGEST), known.filter(F.length("name") >= SHORTEST), "mention", "name", LEAST)
    tiers = tiers.unionByName(near.select("mention", "name", F.lit(4).alias("tier"), F.col("similarity").alias("rank"), F.round(F.col("similarity") * 0.9, 2).alias("confidence")))
    by = F.struct((-F.col("tier")).alias("tier"), "rank", (-F.col("entity")).alias("low"))
    best = tiers.join(known, "name").groupBy("mention").agg(F.max_by(F.struct("entity", "tier", "confidence"), by).alias("b"))
    return said.join(best, "mention", "left").select("p_partkey", "b.entity", "b.tier", r6("b.confidence").alias("confidence"))

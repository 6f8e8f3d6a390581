"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import ann, chat, interpolation, jaccard, licences, neardup, packing, periodic, quality, repair, sentencepiece_bpe, toxicity, url_filter
from marketloom.llm.labelled import fold
from marketloom.llm.storage import table
from marketloom.llm.textops import joined, lean, parts, words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


SAY = "</s>[INST] ok [/INST]"


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAY).alias("text"),
    )
    log = turns.unionByName(extra).withColumns({"seq": F.col("turn"), "event": F.lit("message")})
    back = chat.read_chats(chat.format_chats(log))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op1_chat_formatting"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAY}' UNION ALL SELECT -7, 1, 'assistant', '{SAY}'
), sized AS (
  SELECT *, len(regexp_extract_all(role, '{chat.Template().pattern}')) + len(regexp_extract_all(text, '{chat.Template().pattern}')) AS marks FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + length(role) + 9 + length(text) + marks + 5) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.with_outcomes(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    out = url_filter.filter_urls(pages, URL_RULES, F.col("outcome"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, key: str, parent: str, above: str) -> str:
    """One level of the reputation: its nodes' posteriors from their parents'."""
    return f"""{name}_n AS (
  SELECT {key}, any_value({parent}) AS {parent}, sum(bad) AS bad, sum(n) AS n FROM sites GROUP BY {key}
), {name}_m AS (
  SELECT c.{key}, bad, n, a / (a + b) AS m, a + b AS own FROM {name}_n c JOIN {above} USING ({parent})
), {name}_f AS (
  SELECT sum(n * (bad / n - m) ** 2) AS spread, sum(m * (1 - m)) AS sampled, sum((n - 1) * m * (1 - m)) AS weight FROM {name}_m WHERE n > 1
), {name}_s AS (
  SELECT least(greatest(1 / greatest(CASE WHEN weight > 0 THEN (spread - sampled) / weight ELSE 1 END, 1e-9) - 1, 1), 100) AS strength FROM {name}_f
), {name} AS (
  SELECT {key}, bad + m * s AS a, n - bad + (1 - m) * s AS b
  FROM (SELECT *, 1 / (1 / (own + 1) + 1 / (strength + 1)) - 1 AS s FROM {name}_m, {name}_s)
)"""


_SUFFIXES = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)
_LAST = lambda n: f"array_to_string(list_slice(string_split(site, '.'), -{n}, NULL), '.')"
_FITS = [
    (rule, verdict, f"(host = '{rule[: rule.index('/')]}' OR ends_with(host, '.{rule[: rule.index('/')]}')) AND starts_with(path, '{rule[rule.index('/') :]}')")
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1]))
]
SQL["op5_url_filters"] = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), told AS (
  SELECT CAST(doc_id AS BIGINT) AS shown, max(greatest(toxic, 1 - quality)) AS outcome FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL
), p AS (
  SELECT u.*, outcome, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS site
  FROM u LEFT JOIN told ON shown = try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT)
), sites AS (
  SELECT *, 0 AS whole, CASE WHEN address THEN site WHEN {_LAST(2)} IN ({_SUFFIXES}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain,
    CASE WHEN address THEN site WHEN {_LAST(2)} IN ({_SUFFIXES}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix
  FROM (SELECT site, coalesce(sum(outcome), 0) AS bad, count(outcome) AS n, regexp_matches(site, '{url_filter.ADDRESS}') AS address FROM p WHERE site <> '' GROUP BY site)
), everything AS (SELECT 0 AS whole, sum(bad) + 1.0 AS a, sum(n) - sum(bad) + 1.0 AS b FROM sites),
{_level_sql("suffixes", "suffix", "whole", "everything")}, {_level_sql("domains", "domain", "suffix", "suffixes")}, {_level_sql("hosts", "site", "domain", "domains")},
bounds AS (SELECT site, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound FROM hosts)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for rule, _, fits in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {fits} THEN '{verdict}'" for _, verdict, fits in _FITS)} WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN bounds USING (site)
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _held_out_scores(docs: DataFrame, threshold: float, *more: str) -> DataFrame:
    return docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *more,
    )


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _held_out_scores(toxicity.detect(docs, table(spark, sf_dir, "labels")), 0.5, "offending")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _held_out_scores(quality.classify(docs, table(spark, sf_dir, "labels")), 0.3)


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op4_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts, by crc32 of the id, the words from some word on are said again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in (p for b in lean(batches) for p in parts(b, 1, periodic.STEP)):
            start, end, owner = words(data, offsets)
            n = np.bincount(owner, minlength=len(offsets) - 1)
            h = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in batch.column(0).to_pylist()], np.int64)
            chosen, index = (h % 10 == 0) & (n > 0), np.arange(len(start))
            first = np.cumsum(n) - n
            for k in np.flatnonzero(chosen).tolist():
                g = int(h[k]) // 10
                a = g % int(n[k])
                p = 1 + (int(n[k]) - a) // (3 + g % 8)
                index[first[k] + a : first[k] + n[k]] = first[k] + a + np.arange(int(n[k]) - a) % p
            index = index[chosen[owner]]
            changed = joined(data, start[index], end[index], np.repeat(np.arange(int(chosen.sum())), n[chosen]), int(chosen.sum()))
            text = pc.replace_with_mask(batch.column(1), pa.array(chosen), changed.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(repeated_tails(table(spark, sf_dir, "documents")))


LICENCE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@query
def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [(phrase, label, licences.NOTICES.get(phrase, (label, 0.5))[1]) for phrase, label in LICENCE_PHRASES]
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), base)
    own = F.filter("notices", lambda n: n["phrase"].isin([phrase for phrase, _ in LICENCE_PHRASES]))
    labels = lambda of: F.array_sort(F.array_distinct(F.transform(of, lambda n: n["label"])))
    places = F.transform(own, lambda n: n["word"])
    ids = F.flatten(F.transform("expressions", lambda e: e["ids"]))
    return found.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(labels(own), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels("notices"), ids)), ",").alias("labels"),
        "score", "restriction",
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations' rows with faults planted by crc32 of ``conv_id:turn``; nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, rows = repair.repair(damaged(turns))
    told = report.join(repair.digests(repair.repaired(report, rows)).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    every = turns.select(F.col("conv_id").alias("own")).distinct()
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(told, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("own").alias("conv_id"), *(none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: crc32 of the bytes ``b`` (a list), four bits at a time.
_NIBBLES = "[" + ", ".join(str(_crc) for _crc in (lambda step: [step(step(step(step(i)))) for i in range(16)])(lambda c: c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1)) + "]"
_FOUR = lambda c: f"xor({c} >> 4, {_NIBBLES}[({c} & 15) + 1])"
_CRC32 = lambda b: f"xor(list_reduce(list_prepend(4294967295, {b}), lambda c, x: {_FOUR(_FOUR('xor(c, x)'))}), 4294967295)"
SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ascii(s) AS BIGINT))")} % 20 AS kind
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM hurt
), r AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), edits(src, dst, initial, edit, cost, role) AS (VALUES
  (0, 1, 's', 'K', 0, NULL), (0, 2, 'u', 'K', 0, NULL), (1, 2, 'u', 'K', 0, NULL), (3, 2, 'u', 'K', 0, NULL), (2, 3, 'a', 'K', 0, NULL),
  (0, 2, NULL, 'R', 3, 'user'), (1, 2, NULL, 'R', 3, 'user'), (3, 2, NULL, 'R', 3, 'user'), (2, 3, NULL, 'R', 3, 'assistant'),
  (0, 0, NULL, 'D', 4, NULL), (1, 1, NULL, 'D', 4, NULL), (2, 2, NULL, 'D', 4, NULL), (3, 3, NULL, 'D', 4, NULL)
), inserts(src, dst, edit, cost, lines) AS (VALUES
  (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (3, 2, 'I', 3, ['user:']),
  (2, 3, 'I', 3, ['assistant:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])
), ways AS (
  SELECT e.src, n.dst, e.initial, e.edit AS edit, e.edit || n.edit AS letters, e.cost + n.cost AS cost, e.role, n.lines FROM edits e JOIN inserts n ON e.dst = n.src
), walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS i, n.dst AS state, struct_pack(cost := CAST(n.cost AS BIGINT), audit := CAST(n.edit AS VARCHAR), lines := CAST(n.lines AS VARCHAR[])) AS best
  FROM (SELECT DISTINCT conv_id FROM r) c, inserts n WHERE n.src = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, y.dst, min(struct_pack(
    cost := CAST(w.best.cost + y.cost + CASE WHEN r.fault = 'truncated' AND y.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT), audit := w.best.audit || y.letters,
    lines := w.best.lines || CASE WHEN y.edit = 'D' THEN [] ELSE [coalesce(y.role, r.role) || ':' || r.text] END || y.lines))
  FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN ways y ON y.src = w.state AND (y.initial IS NULL OR y.initial = r.initial) AND (r.fault NOT IN ('blank', 'duplicate') OR y.edit = 'D')
  GROUP BY w.conv_id, w.i + 1, y.dst
), told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min(w.best) AS best FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i WHERE w.state IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

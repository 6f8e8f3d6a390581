"""Documents: cleaning, structure, chunks, versions, and scores for retrieval.

The markdown of a document is its lines, of which every fourth is a heading.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.plans.catalog import query
from marketloom.plans.risk import r6
from marketloom.sources.tables import load

SQL_LINES = """lines AS (
  SELECT doc_id, source, lang, n AS line, CASE WHEN (n - 1) % 4 = 0 THEN repeat('#', CAST(1 + ((n - 1) // 4) % 3 AS INT)) || ' ' || l ELSE l END AS text
  FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(l, n)
)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    doc = load(spark, d, "documents")
    x = doc.select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "l"))
    mark = F.concat(F.repeat(F.lit("#"), (1 + F.expr("n div 4") % 3).cast("int")), F.lit(" "), "l")
    return x.select("doc_id", "source", "lang", (F.col("n") + 1).cast("long").alias("line"), F.when(F.col("n") % 4 == 0, mark).otherwise(F.col("l")).alias("text"))


HEADING = r"^(#{1,6})[ \t]+([^ \t].*)$"


def heading_tree(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Headings of ``rows`` (doc, line, text) with level, title, parent's line, path and last line.

    The parent is the latest heading of a lower level; a section ends before the next
    heading of its level or a lower one. All windows share one shuffle by document.
    """
    level = F.length(F.regexp_extract("text", HEADING, 1))
    whole = Window.partitionBy(doc)
    h = rows.withColumns({"level": level, "title": F.trim(F.regexp_extract("text", HEADING, 2)), "total": F.max("line").over(whole)}).filter("level > 0")
    before, after = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, -1), whole.orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    h = h.withColumns({f"at{k}": F.max(F.when(F.col("level") == k, F.col("line"))).over(before) for k in range(1, 7)})
    h = h.withColumns({f"name{k}": F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(before) for k in range(1, 7)})
    h = h.withColumn("next", F.element_at(F.array(*[F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)]), F.col("level")))
    lower = F.array(*[F.when(F.col("level") > k, F.col(f"at{k}")) for k in range(1, 7)])
    # An ancestor is the latest of its level, if no lower level came after it.
    names = [F.when((F.col("level") > k) & (F.col(f"at{k}") > F.coalesce(F.greatest(*[F.coalesce(f"at{j}", F.lit(0)) for j in range(1, k)]) if k > 2 else F.col("at1") if k == 2 else F.lit(0), F.lit(0))), F.col(f"name{k}")) for k in range(1, 7)]
    return h.select(doc, "line", "level", "title", F.array_max(lower).alias("parent"), F.concat_ws(" > ", *names, "title").alias("path"), F.coalesce(F.col("next") - 1, F.col("total")).alias("last_line"))


@query("heading_tree", rf"""WITH RECURSIVE {SQL_LINES}, h AS (SELECT doc_id, line, length(regexp_extract(text, '{HEADING}', 1)) AS level, trim(regexp_extract(text, '{HEADING}', 2)) AS title FROM lines WHERE regexp_matches(text, '{HEADING}')),
t AS (SELECT doc_id, max(line) AS total FROM lines GROUP BY doc_id), p AS (SELECT h.doc_id, h.line, any_value(h.level) AS level, any_value(h.title) AS title, max(a.line) AS parent FROM h LEFT JOIN h a ON a.doc_id = h.doc_id AND a.line < h.line AND a.level < h.level GROUP BY h.doc_id, h.line),
e AS (SELECT h.doc_id, h.line, min(b.line) AS next FROM h LEFT JOIN h b ON b.doc_id = h.doc_id AND b.line > h.line AND b.level <= h.level GROUP BY h.doc_id, h.line),
r AS (SELECT doc_id, line, title AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.line, r.path || ' > ' || p.title FROM p JOIN r ON r.doc_id = p.doc_id AND r.line = p.parent)
SELECT doc_id, line, level, title, parent, path, coalesce(next - 1, total) AS last_line FROM p JOIN e USING (doc_id, line) JOIN r USING (doc_id, line) JOIN t USING (doc_id)""")
def heading_tree_query(spark: SparkSession, d: str) -> DataFrame:
    return heading_tree(lines(spark, d))


BUDGET, OVERLAP = 400, 60


def split_lines(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """First and last line (from 1) of chunks of at most ``budget`` characters where lines allow; each begins with the last lines, of ``overlap`` characters or more, before it."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > budget:
            out.append((start + 1, i))
            carry, total = i, 0
            while carry > start and total < overlap:
                carry -= 1
                total += sizes[carry]
            start = carry
        total += size
    return [*out, (start + 1, len(sizes))] if sizes else out


def chunk_lines(docs: DataFrame, budget: int = 2800, overlap: int = 320) -> DataFrame:
    """doc_id, chunk, first_line, last_line. The greedy choice depends on all before it: one document is one list of line sizes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *span) for i, sizes in zip(b.doc_id, b.sizes, strict=True) for k, span in enumerate(split_lines(sizes.tolist(), budget, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "first_line", "last_line"])

    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: F.length(l) + 1)
    return docs.select("doc_id", sizes.alias("sizes")).mapInPandas(cut, "doc_id long, chunk long, first_line long, last_line long")


@query("chunk_lines", f"""WITH RECURSIVE l AS (SELECT doc_id, n AS line, length(t) + 1 AS size, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(t, n)),
s AS (SELECT doc_id, line, CAST(1 AS BIGINT) AS first_line, CAST(0 AS BIGINT) AS chunk, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS opened FROM l WHERE line = 1
UNION ALL SELECT n.doc_id, n.line, CASE WHEN n.upto - b.upto + b.size > {BUDGET} THEN greatest(s.first_line, coalesce((SELECT max(c.line) FROM l c WHERE c.doc_id = n.doc_id AND c.line < n.line AND p.upto - c.upto + c.size >= {OVERLAP}), 0)) ELSE s.first_line END,
  s.chunk + CASE WHEN n.upto - b.upto + b.size > {BUDGET} THEN 1 ELSE 0 END, CASE WHEN n.upto - b.upto + b.size > {BUDGET} THEN s.line END, CASE WHEN n.upto - b.upto + b.size > {BUDGET} THEN s.first_line END
  FROM s JOIN l n ON n.doc_id = s.doc_id AND n.line = s.line + 1 JOIN l p ON p.doc_id = s.doc_id AND p.line = s.line JOIN l b ON b.doc_id = s.doc_id AND b.line = s.first_line)
SELECT doc_id, chunk - 1 AS chunk, opened AS first_line, closed AS last_line FROM s WHERE closed IS NOT NULL UNION ALL SELECT doc_id, max(chunk), max(first_line), max(line) FROM s GROUP BY doc_id""")
def chunk_lines_query(spark: SparkSession, d: str) -> DataFrame:
    return chunk_lines(load(spark, d, "documents"), BUDGET, OVERLAP)


#: Line passes in order: name, pattern.
PASSES = (("image", r"^\s*!\[.*\]\(.*\)\s*$"), ("page_number", r"^\s*(page|trang)?\s*[0-9]{1,4}\s*$"), ("contents", r"\.{4,}\s*[0-9]+\s*$"), ("stamp", r"^\s*(digitally signed|signature|stamp)\b"), ("formula", r"^\s*\$+[^$]*\$+\s*$"))


@query("line_cleaner", rf"""WITH l AS (SELECT doc_id, n, t, CASE WHEN trim(t) = '' THEN 'blank' {" ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{n}'" for n, p in PASSES)} WHEN length(t) <= 80 AND row_number() OVER (PARTITION BY doc_id, t ORDER BY n) > 1 THEN 'repeated' END AS why
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(t, n))
SELECT doc_id, count(*) AS lines, count(*) FILTER (why = 'blank') AS blank, count(*) FILTER (why = 'repeated') AS repeated, count(*) FILTER (why NOT IN ('blank', 'repeated')) AS noise, sha256(coalesce(string_agg(rtrim(t), chr(10) ORDER BY n) FILTER (why IS NULL), '')) AS cleaned FROM l GROUP BY doc_id""")
def line_cleaner(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the lines that each pass takes away, and what is left."""
    x = load(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "t"))
    t = F.col("t")
    why = F.when(F.trim(t) == "", "blank")
    for name, pattern in PASSES:
        why = why.when(F.lower(t).rlike(pattern), name)
    again = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("n")) > 1
    x = x.withColumn("why", why.when((F.length(t) <= 80) & again, "repeated"))
    w = F.col("why")
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(w.isNull(), F.struct("n", F.rtrim("t").alias("t"))))), lambda s: s["t"]), "\n")
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(w == "blank").alias("blank"), F.count_if(w == "repeated").alias("repeated"), F.count_if(w.isNotNull() & ~w.isin("blank", "repeated")).alias("noise"), F.sha2(kept, 256).alias("cleaned"))


#: Common words by language, of which the language with most in a text is taken.
COMMON = {
    "en": ("the", "and", "of", "that", "to", "in", "is", "was", "with", "for", "on", "this", "are", "by"), "fr": ("le", "de", "que", "les", "la", "des", "et", "est", "une", "un", "dans", "pour", "sur", "qui"),
    "de": ("der", "die", "und", "ein", "das", "ist", "nicht", "zu", "den", "mit", "von", "eine", "für", "sich"), "es": ("el", "que", "los", "un", "la", "de", "y", "en", "las", "por", "con", "una", "para", "del"),
}


def _word_count(words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w.isin(*words))).cast("long")


@query("document_language", f"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS a FROM documents), c AS (SELECT doc_id, {", ".join(f"len(list_filter(a, lambda x: x IN ({', '.join(repr(v) for v in words)}))) AS {lang}" for lang, words in COMMON.items())} FROM w)
SELECT doc_id, greatest(en, fr, de, es) AS hits, CASE WHEN greatest(en, fr, de, es) < 3 THEN 'unknown' WHEN en >= fr AND en >= de AND en >= es THEN 'en' WHEN fr >= de AND fr >= es THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS language FROM c""")
def document_language(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "documents").select("doc_id", *[_word_count(words).alias(lang) for lang, words in COMMON.items()])
    most = F.greatest(*COMMON)
    en, fr, de, es = (F.col(c) for c in COMMON)
    pick = F.when(most < 3, "unknown").when((en >= fr) & (en >= de) & (en >= es), "en").when((fr >= de) & (fr >= es), "fr").when(de >= es, "de").otherwise("es")
    return c.select("doc_id", most.alias("hits"), pick.alias("language"))


@query("completeness_gate", f"WITH {SQL_LINES}" + """, g AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (trim(text) <> '') AS filled, count(*) FILTER (starts_with(text, '#')) AS headings, sum(length(text)) AS chars FROM lines GROUP BY doc_id)
SELECT doc_id, lines, headings, chars, CASE WHEN filled = 0 OR chars < 40 THEN 'EMPTY' WHEN headings < 2 THEN 'PARTIAL' WHEN filled < 0.8 * lines THEN 'SPARSE' ELSE 'COMPLETE' END AS verdict FROM g""")
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    g = lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("text") != "").alias("filled"), F.count_if(F.col("text").startswith("#")).alias("headings"), F.sum(F.length("text")).alias("chars"))
    verdict = F.when((F.col("filled") == 0) | (F.col("chars") < 40), "EMPTY").when(F.col("headings") < 2, "PARTIAL").when(F.col("filled") < 0.8 * F.col("lines"), "SPARSE").otherwise("COMPLETE")
    return g.select("doc_id", "lines", "headings", "chars", verdict.alias("verdict"))


@query("content_versions", """WITH h AS (SELECT doc_id, source, lang, sha256(trim(coalesce(text, ''))) AS hash FROM documents), u AS (SELECT hash, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY hash)
SELECT doc_id, hash, copies, doc_id <> first_id AS duplicate, doc_id = first_id AND row_number() OVER (PARTITION BY source, lang, doc_id = first_id ORDER BY doc_id DESC) = 1 AS active FROM h JOIN u USING (hash)""")
def content_versions(spark: SparkSession, d: str) -> DataFrame:
    """Equal contents told by their hash; of each source and language the newest that is no copy is active."""
    h = load(spark, d, "documents").select("doc_id", "source", "lang", F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256).alias("hash"))
    u = h.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    x = h.join(u, "hash").withColumn("first", F.col("doc_id") == F.col("first_id"))
    newest = F.row_number().over(Window.partitionBy("source", "lang", "first").orderBy(F.desc("doc_id"))) == 1
    return x.select("doc_id", "hash", "copies", (~F.col("first")).alias("duplicate"), (F.col("first") & newest).alias("active"))


@query("active_documents", """WITH k AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'annual' WHEN 1 THEN 'quarter' ELSE 'governance' END AS role, 2000 + (doc_id * 7) % 24 AS year, CASE WHEN doc_id % 3 = 1 THEN 1 + doc_id % 4 ELSE 4 END AS quarter, n_chars FROM documents)
SELECT source, role, doc_id, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter FROM k QUALIFY row_number() OVER (PARTITION BY source, role ORDER BY year DESC, quarter DESC, n_chars DESC, doc_id) = 1""")
def active_documents(spark: SparkSession, d: str) -> DataFrame:
    """The latest report of each source and role: by year, quarter, then length. An aggregate, so map sides reduce."""
    i = F.col("doc_id")
    k = load(spark, d, "documents").select("doc_id", "source", F.when(i % 3 == 0, "annual").when(i % 3 == 1, "quarter").otherwise("governance").alias("role"), (2000 + (i * 7) % 24).alias("year"), F.when(i % 3 == 1, 1 + i % 4).otherwise(4).alias("quarter"), "n_chars")
    best = k.groupBy("source", "role").agg(F.max(F.struct("year", "quarter", "n_chars", (-i).alias("low"))).alias("b"))
    return best.select("source", "role", (-F.col("b.low")).alias("doc_id"), "b.year", "b.quarter")


PHRASE, TERMS = "the and", ("the", "and", "that")
_HEAD, _BODY = "string_split(coalesce(text, ''), chr(10))[1]", "coalesce(text, '')"
_NORM = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
SQL_LEXICAL = f"""lexical AS (SELECT doc_id, source, n_chars, least(1.0, CASE WHEN contains(t, '{PHRASE.replace(" ", "")}') THEN 0.55 + CASE WHEN contains(h, '{PHRASE.replace(" ", "")}') THEN 0.2 ELSE 0 END ELSE 0 END
  + 0.35 * ({" + ".join(f"CAST(contains(t, '{t}') AS INT)" for t in TERMS)}) / {len(TERMS)} + 0.15 * ({" + ".join(f"CAST(contains(h, '{t}') AS INT)" for t in TERMS)}) / {len(TERMS)}) AS score
  FROM (SELECT doc_id, source, n_chars, {_NORM.format(_HEAD)} AS h, {_NORM.format(_BODY)} AS t FROM documents))"""


def lexical(spark: SparkSession, d: str, phrase: str = PHRASE, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """How well a phrase and its terms fit each document's heading (its first line) and text, up to 1."""
    text = F.coalesce("text", F.lit(""))
    x = load(spark, d, "documents").select("doc_id", "source", "n_chars", T.normalized(F.split(text, "\n")[0]).alias("h"), T.normalized(text).alias("t"))
    whole = phrase.replace(" ", "")
    share = lambda c: sum(F.col(c).contains(t).cast("int") for t in terms) / len(terms)
    score = F.when(F.col("t").contains(whole), 0.55 + F.when(F.col("h").contains(whole), 0.2).otherwise(0.0)).otherwise(0.0) + 0.35 * share("t") + 0.15 * share("h")
    return x.select("doc_id", "source", "n_chars", F.least(F.lit(1.0), score).alias("score"))


@query("lexical_score", f"WITH {SQL_LEXICAL} SELECT doc_id, round(score, 6) AS score FROM lexical")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d).select("doc_id", r6("score").alias("score"))


SQL_DENSE = "dense AS (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.x) AS cosine FROM embeddings e, (SELECT CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id = 0) q WHERE e.embedding IS NOT NULL)"


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with that of the first; the query is one row."""
    e = load(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    q = e.filter("vec_id = 0").select(F.col("x").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", cosine(F.col("x"), F.col("q")).alias("cosine"))


@query("cosine_topk", f"WITH {SQL_DENSE} SELECT vec_id, round(cosine, 6) AS cosine FROM dense ORDER BY cosine DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d).orderBy(F.desc("cosine"), "vec_id").limit(20).select("vec_id", r6("cosine").alias("cosine"))


@query("hybrid_rerank", f"""WITH {SQL_DENSE}, {SQL_LEXICAL}, top AS (SELECT * FROM dense ORDER BY cosine DESC, vec_id LIMIT 80)
SELECT vec_id AS doc_id, round(0.55 * cosine + 0.3 * coalesce(score, 0) + CASE WHEN source IN ('src1', 'src2', 'src3') THEN 0.15 ELSE 0 END, 6) AS score FROM top LEFT JOIN lexical ON doc_id = vec_id
ORDER BY round(0.55 * cosine + 0.3 * coalesce(score, 0) + CASE WHEN source IN ('src1', 'src2', 'src3') THEN 0.15 ELSE 0 END, 6) DESC, vec_id LIMIT 20""")
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Four times as many by cosine as wanted, then the best by cosine, words and role."""
    top = dense(spark, d).orderBy(F.desc("cosine"), "vec_id").limit(80)
    x = lexical(spark, d).join(F.broadcast(top), F.col("doc_id") == F.col("vec_id"), "right")
    bonus = F.when(F.col("source").isin("src1", "src2", "src3"), 0.15).otherwise(0.0)
    score = r6(0.55 * F.col("cosine") + 0.3 * F.coalesce("score", F.lit(0.0)) + bonus)
    return x.select(F.col("vec_id").alias("doc_id"), score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("relevance_floor", f"""WITH {SQL_DENSE}, {SQL_LEXICAL}, c AS (SELECT doc_id, greatest(0, least(1, cosine)) AS raw, score AS lex, row_number() OVER (ORDER BY cosine DESC, vec_id) - 1 AS place, n_chars FROM (SELECT * FROM dense ORDER BY cosine DESC, vec_id LIMIT 60) JOIN lexical ON doc_id = vec_id),
f AS (SELECT *, greatest(0.35, max(raw) OVER () * 0.68) AS least_raw, max(lex) OVER () >= 0.2 AS words, count(*) OVER () AS n FROM c), s AS (SELECT *, least(1.0, least(1.0, raw * 0.5 + (1 - place / greatest(1.0, n - 1)) * 0.2 + lex * 0.3) * CASE WHEN n_chars > 2000 THEN 1.15 WHEN n_chars > 500 THEN 0.9 ELSE 0.4 END) AS score FROM f)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, round(raw, 6) DESC, place, doc_id) AS rank FROM s WHERE CASE WHEN words THEN lex >= 0.2 ELSE raw >= least_raw END""")
def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that words or, where no candidate has any, nearness make relevant; the list is a top-k of 60."""
    top = dense(spark, d).orderBy(F.desc("cosine"), "vec_id").limit(60)
    c = lexical(spark, d).join(F.broadcast(top), F.col("doc_id") == F.col("vec_id"))
    all_ = Window.partitionBy()
    c = c.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine")).alias("raw"), F.col("score").alias("lex"), (F.row_number().over(Window.orderBy(F.desc("cosine"), "vec_id")) - 1).alias("place"), "n_chars")
    c = c.withColumns({"least_raw": F.greatest(F.lit(0.35), F.max("raw").over(all_) * 0.68), "words": F.max("lex").over(all_) >= 0.2, "n": F.count(F.lit(1)).over(all_)})
    mixed = F.least(F.lit(1.0), F.col("raw") * 0.5 + (1 - F.col("place") / F.greatest(F.lit(1.0), F.col("n") - 1)) * 0.2 + F.col("lex") * 0.3)
    fresh = F.when(F.col("n_chars") > 2000, 1.15).when(F.col("n_chars") > 500, 0.9).otherwise(0.4)
    c = c.withColumn("score", F.least(F.lit(1.0), mixed * fresh)).filter(F.when(F.col("words"), F.col("lex") >= 0.2).otherwise(F.col("raw") >= F.col("least_raw")))
    order = Window.orderBy(r6("score").desc(), r6("raw").desc(), "place", "doc_id")
    return c.select("doc_id", r6("score").alias("score"), F.row_number().over(order).cast("long").alias("rank"))


@query("grep_lines", f"WITH {SQL_LINES} SELECT doc_id, line, substr(text, 1, 60) AS shown, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM lines WHERE regexp_matches(lower(text), '\\bthat\\b')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a pattern fits, with the place of the one before."""
    x = lines(spark, d).filter(F.lower("text").rlike(r"\bthat\b"))
    return x.select("doc_id", "line", F.substring("text", 1, 60).alias("shown"), F.lag("line").over(Window.partitionBy("doc_id").orderBy("line")).alias("before"))


@query("entity_resolution", """WITH names AS (SELECT n_nationkey AS entity, lower(n_name) AS name FROM nation), m AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'nation ' || c_nationkey WHEN 2 THEN 'bank of nation_' || c_nationkey || ' ltd' ELSE 'nobody' END AS mention FROM customer),
f AS (SELECT c_custkey, entity, CASE WHEN lower(mention) = name THEN 1.0 WHEN replace(lower(mention), ' ', '_') = name THEN 0.98 WHEN contains(' ' || lower(mention) || ' ', ' ' || name || ' ') THEN 0.8 + 0.15 * length(name) / length(mention) END AS confidence FROM m, names)
SELECT c_custkey, entity, round(confidence, 6) AS confidence FROM f WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY confidence DESC, entity) = 1""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The best tier by which a mention names an entity: exact, alias, or within the mention. The alias table is small and read by each task."""
    i, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    m = load(spark, d, "customer").select("c_custkey", F.when(i % 4 == 0, F.concat(F.lit("NATION_"), n)).when(i % 4 == 1, F.concat(F.lit("nation "), n)).when(i % 4 == 2, F.concat(F.lit("bank of nation_"), n, F.lit(" ltd"))).otherwise("nobody").alias("mention"))
    names = load(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.lower("n_name").alias("name"))
    said = F.lower("mention")
    # A mention's words and the words joined are its keys: equality joins, no comparison of all with all.
    keys = m.select("c_custkey", "mention", F.explode(F.array_distinct(F.array_append(F.split(said, " "), F.replace(said, F.lit(" "), F.lit("_"))))).alias("name"))
    f = keys.join(F.broadcast(names), "name")
    tier = F.when(said == F.col("name"), 1.0).when(F.replace(said, F.lit(" "), F.lit("_")) == F.col("name"), 0.98).otherwise(0.8 + 0.15 * F.length("name") / F.length("mention"))
    best = f.groupBy("c_custkey").agg(F.max(F.struct(tier.alias("confidence"), (-F.col("entity")).alias("low"))).alias("b"))
    return best.select("c_custkey", (-F.col("b.low")).alias("entity"), r6("b.confidence").alias("confidence"))


_RAW = """raws AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN replace(CAST(round(o_totalprice, 1) AS VARCHAR), '.', ',') WHEN 1 THEN '(' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ')'
  WHEN 2 THEN '-1.234.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ',5' WHEN 3 THEN '12,345,678' WHEN 4 THEN '1,23,4' ELSE ' - ' END AS raw FROM orders)"""


@query("number_parse", f"WITH {_RAW} SELECT o_orderkey, raw, round({T.sql_parse_number('raw')}, 4) AS value FROM raws")
def number_parse(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    whole = lambda x: F.floor(x).cast("string")
    raw = (
        F.when(k % 6 == 0, F.replace(F.round(p, 1).cast("string"), F.lit("."), F.lit(",")))
        .when(k % 6 == 1, F.concat(F.lit("("), whole(p / 1000), F.lit("."), F.lpad((F.floor(p) % 1000).cast("string"), 3, "0"), F.lit(")")))
        .when(k % 6 == 2, F.concat(F.lit("-1.234."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",5")))
        .when(k % 6 == 3, "12,345,678").when(k % 6 == 4, "1,23,4").otherwise(" - ")
    )
    return load(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("value", F.round(T.parse_number(F.col("raw")), 4))


@query("statement_table", f"""WITH t AS (SELECT s_suppkey, '| ' || s_name || ' | ' || CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) || '.000 | (' || CAST(s_nationkey AS VARCHAR) || ',5) |' AS row, CASE WHEN s_suppkey % 3 = 0 THEN 'Đơn vị: triệu đồng' WHEN s_suppkey % 3 = 1 THEN 'Unit: billion VND' ELSE 'VND' END AS head FROM supplier),
c AS (SELECT s_suppkey, head, string_split(trim(trim(row, '|')), '|') AS cells FROM t), u AS (SELECT *, {T.sql_fold('head')} AS folded FROM c)
SELECT s_suppkey, trim(cells[1]) AS item, CASE {" ".join(f"WHEN regexp_matches(folded, '{p}') THEN {s}" for s, p in T.UNITS)} ELSE 1.0 END AS scale, round({T.sql_parse_number('trim(cells[2])')}, 2) AS current, round({T.sql_parse_number('trim(cells[3])')}, 2) AS previous FROM u""")
def statement_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a pipe table with their unit's scale and the numbers of two periods."""
    k = F.col("s_suppkey")
    row = F.concat(F.lit("| "), "s_name", F.lit(" | "), F.floor(F.abs("s_acctbal")).cast("long").cast("string"), F.lit(".000 | ("), F.col("s_nationkey").cast("string"), F.lit(",5) |"))
    head = F.when(k % 3 == 0, "Đơn vị: triệu đồng").when(k % 3 == 1, "Unit: billion VND").otherwise("VND")
    t = load(spark, d, "supplier").select("s_suppkey", head.alias("head"), F.split(F.trim(F.regexp_replace(row, r"^\||\|$", "")), r"\|").alias("cells"))
    cell = lambda i: F.trim(F.col("cells")[i])
    return t.select("s_suppkey", cell(0).alias("item"), T.unit_scale(F.col("head")).alias("scale"), F.round(T.parse_number(cell(1)), 2).alias("current"), F.round(T.parse_number(cell(2)), 2).alias("previous"))


@query("fiscal_periods", r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Report Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 1 THEN 'quarter ' || quarter(o_orderdate) || ', fiscal ' || year(o_orderdate) WHEN 2 THEN 'Annual report ' || year(o_orderdate) ELSE 'no period q9' END AS title FROM orders)
SELECT o_orderkey, try_cast(regexp_extract(lower(title), '\bq(?:uarter)?[ ._-]*([1-4])\b', 1) AS INT) AS quarter, try_cast(regexp_extract(title, '\b(19[0-9]{2}|20[0-9]{2})\b', 1) AS INT) AS year FROM t""")
def fiscal_periods(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    q, y = F.quarter(day).cast("string"), F.year(day).cast("string")
    title = F.when(k % 4 == 0, F.concat(F.lit("Report Q"), q, F.lit(" "), y)).when(k % 4 == 1, F.concat(F.lit("quarter "), q, F.lit(", fiscal "), y)).when(k % 4 == 2, F.concat(F.lit("Annual report "), y)).otherwise("no period q9")
    return load(spark, d, "orders").select("o_orderkey", T.fiscal_quarter(title).alias("quarter"), T.fiscal_year(title).alias("year"))


#: Keyword rules in order; the first that fits names the topic.
TRIAGE = (("violence", r"\b(war|attack)\b"), ("statement", r"\b(that|this)\b.*\b(is|was)\b"), ("listing", r"\band\b.*\band\b"), ("short", r"^.{0,200}$"))


@query("news_triage", f"""SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '(?s){p}') THEN '{n}'" for n, p in TRIAGE)} ELSE 'other' END AS topic FROM documents""")
def news_triage(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.coalesce("text", F.lit("")))
    topic = F.when(t.rlike(f"(?s){TRIAGE[0][1]}"), TRIAGE[0][0])
    for name, pattern in TRIAGE[1:]:
        topic = topic.when(t.rlike(f"(?s){pattern}"), name)
    return load(spark, d, "documents").select("doc_id", topic.otherwise("other").alias("topic"))


@query("html_table_rows", r"""WITH i AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<li[^>]*>(.*?)</li>', 1) AS items FROM pages)
SELECT page_id, n AS item, trim(regexp_replace(x, '<[^>]*>', '', 'g')) AS cell FROM i, unnest(items) WITH ORDINALITY AS u(x, n)""")
def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a page's lists as rows, without tags."""
    items = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<li[^>]*>(.*?)</li>"), F.lit(1))
    p = load(spark, d, "pages").select("page_id", F.posexplode(items).alias("n", "x"))
    return p.select("page_id", (F.col("n") + 1).cast("long").alias("item"), F.trim(F.regexp_replace("x", r"<[^>]*>", "")).alias("cell"))

"""URL filters: explicit rules, and empirical-Bayes reputation for the rest.

Labelled page outcomes (1: bad) are counted per host, registered domain and
suffix. Each node's bad rate has a beta prior that comes down from the node above:
its mean is the posterior mean there, and its variance that posterior's own
variance plus the spread of rates between siblings, fitted by moments. So a host
shrinks to its domain, suffix and finally the whole, and where nothing was
labelled on the way the prior stays wide. A page is blocked if the lower bound of
its host's posterior rate is over a threshold; without evidence it is allowed.

Hosts are counted without user part and port; addresses are their own domain and
suffix. Rows with a null url, or one without ``://``, have an empty host and path,
fit no rule and are allowed. Repeated rows are judged alike; empty tables give no
rows; the outcome of a page may be null (not labelled); very long urls are taken
whole. Only the named columns are read. All of it is DataFrame expressions: one
shuffle by host of per-host counts, written once, and one join back in which
adaptive execution splits a hot host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import staged

MAX_RULES = 1000
#: Suffixes of more than one label, by default; hosts under them register one label more.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The host without user part and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(site: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    last2 = F.substring_index(site, ".", -2)
    named = F.when(last2.isin(*suffixes), last2).otherwise(F.substring_index(site, ".", -1))
    return F.when(site.rlike(ADDRESS), site).otherwise(named)


def registered_domain(site: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    last2 = F.substring_index(site, ".", -2)
    named = F.when(last2.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(last2)
    return F.when(site.rlike(ADDRESS), site).otherwise(named)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule of ``(verdict, 'host/path')`` as struct(rule, verdict), else null.

    Rules are configuration, at most ``MAX_RULES`` of them; they become one
    expression without a join. Of equally long ones the longer host wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1])):
        name, at = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(at)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _level(counts: DataFrame, key: str, parent: str, prior: DataFrame, max_strength: float) -> DataFrame:
    """Posteriors (a, b) of one level's nodes, whose priors come from their parents' (prior_a, prior_b).

    The strength s solves, by moments, ``E[(p - m)^2] = m(1-m)/(s+1) + sampling``
    over nodes with two outcomes or more; without such nodes it is the least, 1.
    """
    at = counts.groupBy(key).agg(F.first(parent).alias(parent), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = F.col("prior_a") + F.col("prior_b")
    at = at.join(prior, parent).withColumns({"m": F.col("prior_a") / total, "own": total})
    m, rate = F.col("m"), F.try_divide("bad", "n")
    some = F.col("n") > 1
    fit = at.agg(
        F.sum(F.when(some, F.col("n") * (rate - m) * (rate - m))).alias("spread"),
        F.sum(F.when(some, m * (1 - m))).alias("sampled"),
        F.sum(F.when(some, (F.col("n") - 1) * m * (1 - m))).alias("weight"),
    )
    rho = F.when(F.col("weight") > 0, (F.col("spread") - F.col("sampled")) / F.col("weight")).otherwise(F.lit(1.0))
    strength = F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(float(max_strength)))
    # One row.
    at = at.crossJoin(F.broadcast(fit.select(strength.alias("strength"))))
    # Both variances are m(1-m) over a strength and 1.
    prior_strength = 1 / (1 / (F.col("own") + 1) + 1 / (F.col("strength") + 1)) - 1
    at = at.withColumn("s", prior_strength)
    return at.select(key, (F.col("bad") + m * F.col("s")).alias("a"), (F.col("n") - F.col("bad") + (1 - m) * F.col("s")).alias("b"))


def host_reputation(pages: DataFrame, z: float = 1.645, max_strength: float = 100.0, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Per site: reputation (posterior mean bad rate) and lower_bound (normal approximation of the beta).

    ``pages`` has site and bad (0, 1 or null).
    """
    counts = pages.filter(F.col("site") != "").groupBy("site").agg(F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"), F.count("bad").alias("n"))
    counts = staged(counts, "sites").withColumns({"domain": registered_domain(F.col("site"), suffixes), "suffix": suffix_of(F.col("site"), suffixes), "whole": F.lit(0)})
    prior = counts.groupBy("whole").agg((F.sum("bad") + 1.0).alias("prior_a"), (F.sum("n") - F.sum("bad") + 1.0).alias("prior_b"))
    for key, parent in (("suffix", "whole"), ("domain", "suffix")):
        prior = _level(counts, key, parent, prior, max_strength).withColumnsRenamed({"a": "prior_a", "b": "prior_b"})
    sites = _level(counts, "site", "domain", prior, max_strength)
    a, b = F.col("a"), F.col("b")
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return sites.select("site", mean.alias("reputation"), F.greatest(mean - z * deviation, F.lit(0.0)).alias("lower_bound"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    outcome: Column | None = None,
    threshold: float = 0.5,
    z: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, lower_bound of every page.

    ``outcome`` labels pages (1 bad, 0 good, null unknown). It must not come from the
    rules: they name bad paths only, so a host's other pages would seem bad.
    """
    label = F.lit(None).cast("int") if outcome is None else outcome.cast("int")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), label.alias("bad"))
    p = p.withColumns({"hit": match_rules(F.col("host"), F.col("path"), rules), "site": site_of(F.col("host"))})
    reputation = host_reputation(p.select("site", "bad"), z, suffixes=suffixes)
    judged = p.join(reputation, "site", "left")
    by_method = F.when(F.col("lower_bound") > threshold, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), by_method).alias("verdict"), "reputation", "lower_bound",
    )


def shown_document(path: Column) -> Column:
    """The number that ends a path, as in ``/en/123.html``: of the document that the page shows; null without one."""
    return F.regexp_extract(path, r"([0-9]+)[^0-9/]*/?$", 1).try_cast("long")


def with_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url and outcome: 1 if the document that the page shows is labelled toxic or of poor quality, 0 if neither, else null."""
    bad = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("shown")).agg(F.max(bad).alias("outcome"))
    p = pages.select("page_id", "url", shown_document(path_of(F.col("url"))).alias("shown"))
    return p.join(told, "shown", "left").select("page_id", "url", "outcome")

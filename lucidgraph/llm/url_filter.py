"""URL filtering: fixed rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host. The bad rate is shrunk through beta-binomial priors,
from all pages to the suffix (last label of the host, or the last two where the last but one is a word of SECOND under
a country code), to the registered domain (one label more), to the host: each level takes its parent's posterior mean
as prior mean, with a strength fitted at that level by moments, or the weakest one where none can be fitted. A host is
blocked when it has outcomes and the lower bound of its posterior, mean - z * sd, is above a threshold.

Defined cases: a url that is null or has no "://" has empty host and path and its own (empty) host group; pages
without outcome only lack weight; repeated labels of a page count once, as bad if one is bad; pages that repeat are
judged one by one, and each counts. Rules are (verdict, host, path); of the rules that fit, the longest host + path
wins, and of equally long ones the first. Urls may be of any length; empty tables give no rows; other columns aren't
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import attach_groups, staged, table

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: z of the posterior bound and the bad rate it must exceed; limits of a level's prior strength.
Z, WORST, STRENGTH = 1.645, 0.5, (1.0, 1000.0)
#: Words under a country code that are suffixes with it. Fixed values.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict; nulls where none fits."""
    found = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(found)
    return found


def _strength(bad: Column, n: Column) -> Column:
    """Aggregate: the strength of the beta prior that explains how the rates of these units vary."""
    total, mean = F.sum(n), F.sum(bad) / F.sum(n)
    spread = F.sum(bad * bad / n) - F.sum(bad) * F.sum(bad) / total  # sum of n * (rate - mean) ** 2
    noise = mean * (1 - mean)
    between = (spread - (F.count(n) - 1) * noise) / (total - F.sum(n * n) / total)
    low, high = (F.lit(x) for x in STRENGTH)
    # rates that vary no more than by chance fit the strongest prior; one unit, or rates all 0 or all 1, fit none
    fitted = F.when((noise <= 0) | (total - F.sum(n * n) / total <= 0), low).when(between <= 0, high).otherwise(noise / between - 1)
    return F.greatest(low, F.least(high, F.coalesce(fitted, low)))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, bad (0, 1 or null). One row a host: host, n, mean, bound."""
    counts = outcomes.groupBy("host").agg(F.sum(F.coalesce(F.col("bad"), F.lit(0))).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
    parts = F.split("host", r"\.")
    labels = F.when(F.col("host").rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$"), 2).otherwise(1)
    last = lambda n: F.when(F.size(parts) > n, F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n))).otherwise(F.col("host"))
    hosts = staged(counts.withColumn("domain", last(labels + 1)).withColumn("suffix", last(labels)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("units"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.countDistinct("domain").alias("units"))
    strength = lambda level: level.filter("n > 0").agg(_strength(F.col("bad"), F.col("n")).alias("s"))
    whole = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("mean"))
    top = [t.first()[0] for t in (whole, strength(suffixes), strength(domains), strength(hosts))]  # four numbers
    base, s_suffix, s_domain, s_host = (F.lit(float(x)) if x is not None else F.lit(0.5) for x in top)
    mean = lambda s, prior: (F.col("bad") + s * prior) / (F.col("n") + s)
    n_hosts = hosts.count()
    suffixes = staged(suffixes.select("suffix", "units", mean(s_suffix, base).alias("prior")), "suffixes")
    domains = attach_groups(domains, suffixes.withColumnRenamed("units", "_units"), "suffix", "_units", n_hosts)
    domains = staged(domains.select("domain", "units", mean(s_domain, F.col("prior")).alias("prior")), "domains")
    out = attach_groups(hosts, domains, "domain", "units", n_hosts)
    a, b = F.col("bad") + s_host * F.col("prior"), F.col("n") - F.col("bad") + s_host * (1 - F.col("prior"))
    post = a / (a + b)
    return out.select("host", "n", post.alias("mean"), (post - Z * F.sqrt(post * (1 - post) / (a + b + 1))).alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, worst: float = WORST) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, bad. One row a page: page_id, host, path, rule, verdict."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = seen.select("page_id", "host").join(labels.filter("page_id is not null"), "page_id", "left")
    per_host = seen.groupBy("host").agg(F.count("*").alias("pages"))
    hosts = staged(host_reputation(known).join(per_host, "host").select("host", "pages", ((F.col("n") > 0) & (F.col("bound") > worst)).alias("_bad")), "reputation")
    judged = attach_groups(seen, hosts, "host", "pages", pages.count())
    found = rule_of(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_rule", found).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.rule_verdict"), F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad when the labels of its id say toxic or of low quality."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0).alias("bad"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), labelled_outcomes(table(spark, sf_dir, "labels")))


OP10_SQL = r"""
WITH seen AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), outcome AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, array_to_string(labels[-k - 1:], '.') AS domain, array_to_string(labels[-k:], '.') AS suffix, bad, n
  FROM (SELECT host, string_split(host, '.') AS labels, CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k,
          sum(coalesce(bad, 0))::DOUBLE AS bad, count(bad)::DOUBLE AS n
        FROM seen LEFT JOIN outcome USING (page_id) GROUP BY host)
), domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL),
units AS (
  SELECT 'suffix' AS level, bad, n FROM suffixes WHERE n > 0 UNION ALL
  SELECT 'domain', bad, n FROM domains WHERE n > 0 UNION ALL
  SELECT 'host', bad, n FROM hosts WHERE n > 0
), moments AS (
  SELECT level, sum(n) AS total, sum(bad) / sum(n) AS mean, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS spread,
         count(n) AS units, sum(n) - sum(n * n) / sum(n) AS free
  FROM units GROUP BY level
), strengths AS (
  SELECT level, greatest(1.0, least(1000.0, CASE WHEN mean * (1 - mean) <= 0 OR free <= 0 THEN 1.0 WHEN spread - (units - 1) * mean * (1 - mean) <= 0
    THEN 1000.0 ELSE mean * (1 - mean) / ((spread - (units - 1) * mean * (1 - mean)) / free) - 1 END)) AS s FROM moments
), p0 AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM hosts),
p1 AS (SELECT suffix, (bad + s * (SELECT mean FROM p0)) / (n + s) AS prior FROM suffixes, (SELECT s FROM strengths WHERE level = 'suffix')),
p2 AS (SELECT domain, (bad + s * prior) / (n + s) AS prior FROM domains JOIN p1 USING (suffix), (SELECT s FROM strengths WHERE level = 'domain')),
p3 AS (
  SELECT host, n, bad + s * prior AS a, n - bad + s * (1 - prior) AS b
  FROM hosts JOIN p2 USING (domain), (SELECT s FROM strengths WHERE level = 'host')
), reputation AS (SELECT host, n > 0 AND a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS bad FROM p3),
rules(verdict, site, prefix) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
matched AS (
  SELECT host, path, arg_max(site || prefix, length(site || prefix)) AS rule, arg_max(verdict, length(site || prefix)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM seen) JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN reputation.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM seen JOIN reputation USING (host) LEFT JOIN matched USING (host, path)
"""

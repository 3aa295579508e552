"""Operator 4: URL filters by empirical-Bayes host reputation, on DataFrame functions only.

Labelled outcomes of pages (good or bad) are counted for each host, registered
domain and public suffix. Each level's rate is a beta-binomial posterior mean
whose prior is the level above: the suffix is shrunk to all outcomes, the
domain to its suffix, the host to its domain. How many outcomes a prior weighs
is estimated from the counts themselves, for each level by the moments of the
beta-binomial: the less the names of a level differ beyond chance, the more
their prior weighs (1 to 999 outcomes). A host is blocked when the bound of its posterior,
mean - ``z`` standard deviations, says that its share of bad pages lies above
``limit``; unknown hosts take the posterior of the nearest known level.

Rules (host, path) come first: a rule fits its host and every subdomain when
the url's path starts with the rule's path; the longest rule wins.

Edge cases: a null url, or one without ``://``, has an empty host and path,
meets no rule and is judged by the suffix level of the empty host; null
outcomes count nothing; without outcomes everything that no rule blocks is
allowed; repeated rows are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.skew import split_join

from .common import first_columns, stage, table

#: Suffixes of two labels under which names are registered; all others have one label. Fixed values.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
                      "com.sg", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix(name: Column, two_labels=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(name, ".", -1))


def domain(name: Column, two_labels=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(name: Column, at: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule overrides
        fits = ((name == of) | F.endswith(name, F.lit("." + of))) & F.startswith(at, F.lit(prefix))
        text = F.when(fits, F.lit(of + prefix)).otherwise(text)
        verdict = F.when(fits, F.lit(act)).otherwise(verdict)
    return text, verdict


def prior_weight(level: DataFrame, prior: Column) -> Column:
    """Outcomes that the prior weighs, from the spread of bad / n around it."""
    chance = prior * (1 - prior)
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - prior, F.lit(2)) - chance)
    rho = F.greatest(F.least(F.coalesce(F.round(F.try_divide(spread, F.sum(chance * (F.col("n") - 1))), 9), F.lit(0.0)), F.lit(0.5)), F.lit(0.001))
    return level.agg(((1 - rho) / rho).alias("weight")).scalar()


def reputation(outcomes: DataFrame, two_labels=TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """From rows (host, bad): tables of suffixes, domains and hosts with their
    posterior means, the hosts with their posterior weight, and the overall rate."""
    hosts = outcomes.where("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = stage(hosts.withColumns({"domain": domain(F.col("host"), two_labels), "suffix": suffix(F.col("host"), two_labels)}), "reputation-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    base = F.coalesce(suffixes.agg(F.sum("bad") / F.sum("n")).scalar(), F.lit(0.0))
    levels = []
    for level, prior in ((suffixes, base), (domains, F.col("suffix_rate")), (hosts, F.col("domain_rate"))):
        key = level.columns[0]
        if levels:
            level = level.join(levels[-1].select(prior_key, prior), prior_key)
        weight = prior_weight(level, prior) + F.col("n")
        levels.append(stage(level.select(key, weight.alias(f"{key}_weight"), ((F.col("bad") + (weight - F.col("n")) * prior) / weight).alias(f"{key}_rate")), f"reputation-{key}"))
        prior_key = key
    suffixes, domains, hosts = levels
    return suffixes, domains, hosts, base


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          z: float = 1.0, limit: float = 0.3, two_labels=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior ``rate`` and ``bound``.

    Each different host is judged once: urls are grouped by host before the
    tables of the levels are joined, so that a hot host is one row there. Pages
    meet their host's judgement by a join that splits the hosts measured to hold
    more than a task's share of pages, and no others. ``two_labels``: the suffixes of two
    labels under which names are registered."""
    pages = first_columns(pages, page_id=id_col, url=url_col).select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    suffixes, domains, hosts, base = reputation(outcomes, two_labels)
    names = pages.select("host").distinct().withColumns({"domain": domain(F.col("host"), two_labels), "suffix": suffix(F.col("host"), two_labels)})
    rate = F.coalesce("host_rate", "domain_rate", "suffix_rate", base)
    # an unknown host has what its domain's or suffix's posterior weighs, and no outcome at all counts as one
    weight = F.coalesce("host_weight", "domain_weight", "suffix_weight", F.lit(1.0))
    names = (names.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
             .select("host", rate.alias("rate"), (rate - z * F.sqrt(rate * (1 - rate) / (weight + 1))).alias("bound")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return split_join(pages, names, "host", "inner").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "rate", "bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (host, bad) of pages: the second part of a page's path is the
    number of the document it shows, whose label says good or bad."""
    number = F.regexp_extract(path(F.col("url")), r"^/[^/]+/(\d{1,18})(?:\D|$)", 1)
    of = pages.select(host(F.col("url")).alias("host"), F.when(number != "", number).cast("long").alias("id")).where("id is not null")
    marks = first_columns(labels, id="doc_id", quality="quality", toxic="toxic").groupBy("id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0)).alias("bad"))
    return of.join(marks, "id").select("host", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled_outcomes(first_columns(pages, url="url"), table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH page AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
mark AS (
  SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
outcome AS (
  SELECT host, bad FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/(\d{1,18})(?:\D|$)', 1), '') AS BIGINT) AS id FROM page) p
  JOIN mark USING (id) WHERE bad IS NOT NULL),
part AS (
  SELECT *, string_split(host, '.') AS p,
    array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx',
      'com.sg', 'com.tr', 'com.tw', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk') AS two
  FROM (SELECT DISTINCT host FROM page)),
name AS (
  SELECT host, array_to_string(list_slice(p, CASE WHEN two THEN -3 ELSE -2 END, NULL), '.') AS domain,
    array_to_string(list_slice(p, CASE WHEN two THEN -2 ELSE -1 END, NULL), '.') AS suffix FROM part),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM outcome JOIN name USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
base AS (SELECT coalesce(sum(bad)::DOUBLE / sum(n), 0) AS rate FROM s),
s0 AS (SELECT s.*, rate AS prior FROM s, base),
sw AS (SELECT (1 - rho) / rho AS w FROM (SELECT greatest(least(coalesce(round(sum(n * pow(bad::DOUBLE / n - prior, 2) - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 9), 0), 0.5::DOUBLE), 0.001::DOUBLE) AS rho FROM s0)),
s1 AS (SELECT suffix, w + n AS weight, (bad + w * prior) / (w + n) AS rate FROM s0, sw),
d0 AS (SELECT d.*, s1.rate AS prior FROM d JOIN s1 USING (suffix)),
dw AS (SELECT (1 - rho) / rho AS w FROM (SELECT greatest(least(coalesce(round(sum(n * pow(bad::DOUBLE / n - prior, 2) - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 9), 0), 0.5::DOUBLE), 0.001::DOUBLE) AS rho FROM d0)),
d1 AS (SELECT domain, w + n AS weight, (bad + w * prior) / (w + n) AS rate FROM d0, dw),
h0 AS (SELECT h.*, d1.rate AS prior FROM h JOIN d1 USING (domain)),
hw AS (SELECT (1 - rho) / rho AS w FROM (SELECT greatest(least(coalesce(round(sum(n * pow(bad::DOUBLE / n - prior, 2) - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 9), 0), 0.5::DOUBLE), 0.001::DOUBLE) AS rho FROM h0)),
h1 AS (SELECT host, w + n AS weight, (bad + w * prior) / (w + n) AS rate FROM h0, hw),
posterior AS (
  SELECT host, coalesce(h1.rate, d1.rate, s1.rate, (SELECT rate FROM base)) AS rate, coalesce(h1.weight, d1.weight, s1.weight, 1.0::DOUBLE) AS weight
  FROM name LEFT JOIN h1 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix)),
ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM page)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN rate - 1.0 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN posterior USING (host)
"""

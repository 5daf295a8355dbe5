"""URL filter: allow and block rules, and an empirical-Bayes reputation of hosts for urls without a rule.

Urls that a rule decides are the labelled outcomes (block is bad, allow is good), or a table of outcomes is given. Bad
rates shrink level by level through beta-binomial priors: all urls to public suffix, suffix to registered domain,
domain to host. How much a prior is worth at a level is estimated from the outcomes, by the moments of the rates around
their priors. A url without a rule is blocked where the lower posterior bound of its host's bad rate exceeds the
limit. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, skew_lookup, stored, table

#: (verdict, host, path prefix); the longest fitting rule wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Pseudo-observations that a level's prior is worth to the level below: where labels don't tell, least and most.
STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 20.0, 1.0, 1000.0
#: Labels that make a public suffix together with a country's two letters, such as co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Standard deviations below the posterior mean, and the bad rate that the bound must exceed.
BOUND_Z, BAD_LIMIT = 1.0, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, host and path together; nulls if none fits. Ties go to the first."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix): the suffix is the last label, or two such as co.uk; the domain has one more."""
    two = F.substring_index(host, ".", -2)
    double = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    return F.when(double, F.substring_index(host, ".", -3)).otherwise(two), F.when(double, two).otherwise(F.substring_index(host, ".", -1))


def strength(groups: DataFrame, n: str, bad: str, prior: Column) -> float:
    """Pseudo-observations that the priors of ``groups`` are worth, by moments of the beta-binomial.

    A group with ``n`` outcomes and prior p has E[n (rate - p)^2] = p (1 - p) (1 + (n - 1) r), and r = 1 / (strength + 1).
    """
    g = groups.where(F.col(n) > 0).select(F.col(n).cast("double").alias("n"), (F.col(bad) / F.col(n)).alias("rate"), prior.alias("p"))
    spread = F.col("p") * (1 - F.col("p"))
    seen, noise, weight = g.agg(F.sum(F.col("n") * (F.col("rate") - F.col("p")) * (F.col("rate") - F.col("p"))), F.sum(spread), F.sum((F.col("n") - 1) * spread)).first()  # one row
    if not weight:
        return STRENGTH
    r = (seen - noise) / weight
    return MOST_STRENGTH if r <= 1 / (MOST_STRENGTH + 1) else max(LEAST_STRENGTH, 1 / r - 1)


def reputation(counts: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """``counts(host, n, labelled, bad)`` to (host, n, bound): the lower posterior bound of each host's bad rate."""
    domain, suffix = levels(F.col("host"))
    h = counts.withColumn("domain", domain).withColumn("suffix", suffix)
    d = h.groupBy("suffix", "domain").agg(F.sum("labelled").alias("d_n"), F.sum("bad").alias("d_bad"))
    s = d.groupBy("suffix").agg(F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad"))
    bad, n = s.agg(F.sum("s_bad"), F.sum("s_n")).first()  # one row
    p_a = F.lit(((bad or 0) + 1.0) / ((n or 0) + 2.0))
    rate = lambda bad, n, prior, worth: (F.col(bad) + F.lit(worth) * prior) / (F.col(n) + F.lit(worth))
    s = s.select(F.col("suffix").alias("s_key"), rate("s_bad", "s_n", p_a, strength(s, "s_n", "s_bad", p_a)).alias("p_s"))
    d = d.join(s, F.col("suffix") == F.col("s_key"))
    p_d = rate("d_bad", "d_n", F.col("p_s"), strength(d, "d_n", "d_bad", F.col("p_s")))
    d = d.select(F.col("suffix").alias("d_suffix"), F.col("domain").alias("d_key"), p_d.alias("p_d"))
    h = h.join(d, (F.col("suffix") == F.col("d_suffix")) & (F.col("domain") == F.col("d_key")))
    worth = F.lit(strength(h, "labelled", "bad", F.col("p_d")))
    a = F.col("bad") + worth * F.col("p_d")
    t = F.col("labelled") + worth
    mean = a / t
    bound = mean - F.lit(z) * F.sqrt(mean * (1.0 - mean) / (t + 1.0))
    return h.select("host", "n", bound.alias("bound"))


def url_filter(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = BAD_LIMIT, outcomes: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, bound), a row for each input row.

    ``outcomes(host, bad)`` adds labelled pages to those that rules decide. A null url has an empty host and path and no
    rule; the empty host has a reputation like any other. Repeated rows stay. An empty table gives an empty one.
    """
    host, path = split_url(F.col(url_col))
    pages = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    seen = pages.select("host", F.lit(1).alias("n"), F.col("ruled").isNotNull().cast("long").alias("labelled"), (F.col("ruled") == "block").cast("long").alias("is_bad"))
    if outcomes is not None:
        seen = seen.union(outcomes.select("host", F.lit(0), F.lit(1).cast("long"), F.col("bad").cast("long")))
    counts = stored(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad")), "hosts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = reputation(counts).select(F.xxhash64("host").alias("k1"), F.xxhash64(F.lit(7), "host").alias("k2"), "n", "bound")
    keyed = pages.withColumn("k1", F.xxhash64("host")).withColumn("k2", F.xxhash64(F.lit(7), "host"))
    out = skew_lookup(keyed, known, ["k1", "k2"], "n", max(total, 1), ["bound"], F.struct("id", "path"))
    return out.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "bound")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE WHEN dot LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN dot LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN dot LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN dot LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN dot LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM (SELECT *, '.' || host AS dot FROM p)
), v AS (
  SELECT *, CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block'
                      WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block' END AS ruled,
         regexp_matches(two, '^(ac|co|com|edu|gov|net|org)[.][a-z][a-z]$') AS twofold
  FROM (SELECT *, CASE WHEN instr(host, '.') > 0 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS two FROM r)
), w AS (
  SELECT *, CASE WHEN twofold THEN two ELSE split_part(host, '.', -1) END AS suffix,
         CASE WHEN twofold AND len(string_split(host, '.')) > 2 THEN split_part(host, '.', -3) || '.' || two ELSE two END AS domain FROM v
), h AS (SELECT host, domain, suffix, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS bad FROM w GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
a AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS p FROM s),
gs AS (SELECT suffix, n, bad, a.p AS p FROM s, a),
ms AS (SELECT CASE WHEN coalesce(weight, 0) = 0 THEN 20.0::DOUBLE WHEN (seen - noise) / weight <= 1 / 1001.0::DOUBLE THEN 1000.0::DOUBLE ELSE greatest(1.0::DOUBLE, weight / (seen - noise) - 1) END AS m
  FROM (SELECT sum(n * (bad / n::DOUBLE - p) ** 2) AS seen, sum(p * (1 - p)) AS noise, sum((n - 1) * p * (1 - p)) AS weight FROM gs WHERE n > 0)),
ps AS (SELECT suffix, (bad + m * p) / (n + m) AS p FROM gs, ms),
gd AS (SELECT d.suffix, domain, n, bad, ps.p AS p FROM d JOIN ps ON d.suffix = ps.suffix),
md AS (SELECT CASE WHEN coalesce(weight, 0) = 0 THEN 20.0::DOUBLE WHEN (seen - noise) / weight <= 1 / 1001.0::DOUBLE THEN 1000.0::DOUBLE ELSE greatest(1.0::DOUBLE, weight / (seen - noise) - 1) END AS m
  FROM (SELECT sum(n * (bad / n::DOUBLE - p) ** 2) AS seen, sum(p * (1 - p)) AS noise, sum((n - 1) * p * (1 - p)) AS weight FROM gd WHERE n > 0)),
pd AS (SELECT suffix, domain, (bad + m * p) / (n + m) AS p FROM gd, md),
gh AS (SELECT host, n, bad, pd.p AS p FROM h JOIN pd ON h.suffix = pd.suffix AND h.domain = pd.domain),
mh AS (SELECT CASE WHEN coalesce(weight, 0) = 0 THEN 20.0::DOUBLE WHEN (seen - noise) / weight <= 1 / 1001.0::DOUBLE THEN 1000.0::DOUBLE ELSE greatest(1.0::DOUBLE, weight / (seen - noise) - 1) END AS m
  FROM (SELECT sum(n * (bad / n::DOUBLE - p) ** 2) AS seen, sum(p * (1 - p)) AS noise, sum((n - 1) * p * (1 - p)) AS weight FROM gh WHERE n > 0)),
ph AS (SELECT host, (bad + m * p) / (n + m) AS m, n + m AS t FROM gh, mh)
SELECT w.page_id, w.host, w.path, w.rule,
       coalesce(w.ruled, CASE WHEN ph.m - 1.0::DOUBLE * sqrt(ph.m * (1.0::DOUBLE - ph.m) / (ph.t + 1.0::DOUBLE)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM w JOIN ph ON w.host = ph.host
"""

"""URL filters by empirical-Bayes host reputation.

Rules of host and path decide the pages that they fit.  For the others a host's share
of bad pages is estimated from labelled outcomes: a beta-binomial model whose prior mean
is the posterior mean of the host's registered domain, whose prior in turn is that of its
suffix, whose prior is that of all outcomes.  The weight of each prior comes from the
spread of the shares at that level (moments of the beta-binomial).  A page is blocked
where even the lower posterior bound of its host's share is above LIMIT.

Levels are those of the host without user, port and trailing dot.  Its suffix is the longest that a
table of suffix rules gives (plain names, `*.` for any label, `!` for exceptions; SUFFIXES unless given), else its last label; the
registered domain has one label more.  An IP address is its own domain, under the suffix IP.  The bound is the
normal approximation of the beta posterior's lower bound.  In the query the labelled outcomes are the pages
that a rule decides: block is bad, allow is good; judged() takes a table of outcomes instead.

Defined results: null urls, and urls without ://, have an empty host and path; of rules
that fit, the longest host and path together wins, then the longer host, then the first
listed; without outcomes every share is one half and no page is blocked; rows are judged
one by one, so repeated rows and null ids come back as they are; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, saved, table

#: host, path, verdict (fixed values).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Suffix rules of several labels: these second levels under these countries, and a wildcard with its exception.
SECOND, COUNTRIES = ("ac", "co", "com", "edu", "gov", "net", "org"), ("ar", "au", "br", "cn", "il", "in", "jp", "kr", "mx", "nz", "th", "tr", "tw", "uk", "za")
SUFFIXES = (*(f"{s}.{c}" for c in COUNTRIES for s in SECOND), "*.ck", "!www.ck")
IP = "(ip)"
LIMIT, SIGMAS = 0.5, 1.6448536269514722
#: Bounds of the correlation of outcomes within a group; a prior weighs (1 - r) / r outcomes.
RHO_LOW, RHO_HIGH = 0.005, 0.5
INLINE_RULES = 100


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _by_rank(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict or null).

    Up to INLINE_RULES rules are one expression; more are joined on the suffixes of each distinct host and path.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) <= INLINE_RULES:
        best = F.lit(None).cast("struct<rule: string, verdict: string>")
        for h, p, verdict in reversed(_by_rank(rules)):
            fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
            best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
        return rows.withColumn("best", best).select("page_id", "host", "path", "best.rule", F.col("best.verdict").alias("ruled"))
    listed = [(h, p, verdict, k) for k, (h, p, verdict) in enumerate(_by_rank(rules))]
    listed = pages.sparkSession.createDataFrame(listed, "end string, start string, verdict string, rank int")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    some = rows.select("host", "path").distinct()
    some = some.withColumn("end", F.explode(ends)).join(hinted(listed), "end").where(F.col("path").startswith(F.col("start")))
    some = some.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("end", "start").alias("rule"), F.col("verdict").alias("verdict")), "rank").alias("best"))
    out = rows.join(some, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "best.rule", F.col("best.verdict").alias("ruled"))


def with_levels(hosts: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """hosts (distinct host) with domain and suffix.  suffixes: rules, or a table with them in a column `rule`."""
    if not isinstance(suffixes, DataFrame):
        suffixes = hosts.sparkSession.createDataFrame([(s,) for s in suffixes], "rule string")
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    name = F.regexp_replace(name, r"\.$", "")
    rows = hosts.withColumn("name", name).withColumn("ip", name.rlike(r"^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    labels = F.split("name", r"\.")
    rows = rows.withColumn("labels", labels)
    of = lambda depth: F.array_join(F.slice("labels", F.greatest(F.size("labels") - depth + 1, F.lit(1)), depth), ".")
    # the ends of every name that a rule may fit: the deepest such end is the suffix, an exception has one label less
    ends = rows.where("NOT ip").select("host", F.posexplode(F.reverse(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")))).alias("above", "end"))
    asked = suffixes.select("rule", F.regexp_replace("rule", r"^(!|\*\.)", "").alias("end"))
    asked = asked.groupBy("end").agg(F.max(F.when(~F.col("rule").rlike(r"^[!*]"), 0)).alias("plain"), F.max(F.when(F.col("rule").startswith("*"), 1)).alias("wild"), F.max(F.when(F.col("rule").startswith("!"), -1)).alias("but"))
    fits = ends.join(hinted(saved(asked, "suffixes")), "end")
    fits = fits.groupBy("host").agg(F.max(F.col("above") + 1 + F.col("but")).alias("but"), F.max(F.col("above") + 1 + F.coalesce("wild", "plain")).alias("most"))
    rows = rows.join(fits, "host", "left")
    depth = F.least(F.coalesce("but", "most", F.lit(1)), F.size("labels"))
    return rows.select(*hosts.columns, F.when(F.col("ip"), IP).otherwise(of(depth)).alias("suffix"), F.when(F.col("ip"), F.col("name")).otherwise(of(depth + 1)).alias("domain"))


def _shrunk(groups: DataFrame, mean: str) -> DataFrame:
    """groups (n, bad and the prior mean in column `mean`) with posterior `share` and `weight`."""
    m = F.col(mean)
    got = groups.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") / F.col("n") - m, 2) * F.col("n")).alias("spread"),
        F.sum(m * (1 - m)).alias("chance"),
        F.sum(m * (1 - m) * (F.col("n") - 1)).alias("room"),
    ).first()
    rho = (got.spread - got.chance) / got.room if got.room else RHO_LOW
    k = 1 / min(RHO_HIGH, max(RHO_LOW, rho)) - 1
    return groups.withColumn("share", (m * k + F.col("bad")) / (k + F.col("n"))).withColumn("weight", F.lit(k) + F.col("n"))


def reputations(outcomes: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """host, n, bad, share, bound of every host of hosts.

    outcomes: host, n, bad (counts of labelled pages, one row per host).  hosts: distinct host.
    """
    rows = saved(with_levels(hosts.join(outcomes, "host", "left").fillna(0, ["n", "bad"]), suffixes), "hosts")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = rows.groupBy("suffix").agg(*sums).withColumn("prior", F.lit((total.bad + 0.5) / (total.n + 1)))
    suffixes = hinted(saved(_shrunk(saved(suffixes), "prior").select("suffix", F.col("share").alias("suffix_share")), "suffixes"))
    domains = saved(rows.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix"))
    domains = hinted(saved(_shrunk(domains, "suffix_share").select("suffix", "domain", F.col("share").alias("domain_share")), "domains"))
    rows = _shrunk(saved(rows.join(domains, ["suffix", "domain"])), "domain_share")
    bound = F.col("share") - SIGMAS * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("weight") + 1))
    return rows.select("host", "n", "bad", "share", bound.alias("bound"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, outcomes: DataFrame | None = None, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.  outcomes: see reputations(); the rules' verdicts if None."""
    rows = saved(ruled(pages, rules), "ruled")
    if outcomes is None:
        labelled = rows.where("ruled IS NOT NULL")
        outcomes = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"))
    hosts = saved(reputations(outcomes, rows.select("host").distinct(), suffixes), "reputations")
    bad = hinted(saved(hosts.where(F.col("bound") > LIMIT).select("host", F.lit("block").alias("method")), "bad"))
    rows = rows.join(bad, "host", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), j AS (
  SELECT page_id, host, path,
         (SELECT arg_max({'rule': h || p, 'v': v}, length(h) + length(p)) FROM r
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM u
), h1 AS (
  SELECT host, count(best.rule) AS n, count(*) FILTER (best.v = 'block') AS bad,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS name
  FROM j GROUP BY host
), h2 AS (
  SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AS ip,
         CASE WHEN regexp_matches(name, '(^|\.)www\.ck$') THEN 1 WHEN regexp_matches(name, '\.ck$') THEN 2
              WHEN regexp_matches(name, '(^|\.)(@SECOND)\.(@COUNTRIES)$') THEN 2 ELSE 1 END AS k FROM h1
), h0 AS (
  SELECT host, n, bad, CASE WHEN ip THEN name ELSE array_to_string(l[-least(k + 1, len(l)):], '.') END AS domain,
         CASE WHEN ip THEN '(ip)' ELSE array_to_string(l[-least(k, len(l)):], '.') END AS suffix FROM h2
), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM h0) AS m FROM h0 GROUP BY suffix),
sk AS (
  SELECT 1 / least(0.5, greatest(0.005, coalesce((sum(pow(bad / n - m, 2) * n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.005))) - 1 AS k
  FROM s0 WHERE n > 0
), s AS (SELECT suffix, (m * k + bad) / (k + n) AS m FROM s0, sk),
d0 AS (SELECT domain, any_value(s.m) AS m, sum(n) AS n, sum(bad) AS bad FROM h0 JOIN s USING (suffix) GROUP BY domain),
dk AS (
  SELECT 1 / least(0.5, greatest(0.005, coalesce((sum(pow(bad / n - m, 2) * n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.005))) - 1 AS k
  FROM d0 WHERE n > 0
), d AS (SELECT domain, (m * k + bad) / (k + n) AS m FROM d0, dk),
hk AS (
  SELECT 1 / least(0.5, greatest(0.005, coalesce((sum(pow(bad / n - m, 2) * n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.005))) - 1 AS k
  FROM h0 JOIN d USING (domain) WHERE n > 0
), h AS (SELECT host, (m * k + bad) / (k + n) AS m, k + n AS w FROM h0 JOIN d USING (domain), hk)
SELECT page_id, j.host, path, best.rule AS rule,
       coalesce(best.v, CASE WHEN m - 1.6448536269514722 * sqrt(m * (1 - m) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN h ON j.host = h.host
"""
OP3_SQL = OP3_SQL.replace("@SECOND", "|".join(SECOND)).replace("@COUNTRIES", "|".join(COUNTRIES))

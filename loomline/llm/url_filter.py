"""URL filter: rules first, then an empirical-Bayes reputation of hosts; DataFrame functions only.

Labelled outcomes of pages are summed by host. Three levels shrink each other through beta-binomial
priors: a suffix's rate towards the rate of all, a registered domain's towards its suffix, a host's
towards its domain. The weight of each prior comes from the spread of the rates at that level
(method of moments). A page whose host has a lower posterior bound over `most_bad` is blocked.

The query takes the label of the document of the same number as a page's (page_id = doc_id), as the tables have no other; registered domains are
told by TWO_LABEL_SUFFIXES alone, a short list.

Cases: a null url or one without "://" has empty host and path and shares the host "" with its like;
equal rows are judged each; a page with several labels counts once, as bad if any is; without labels
every host is allowed; an empty table gives an empty table; columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are tried in place; more are joined by host.
INLINE_RULES = 200
#: Suffixes of two labels under which names are registered; others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """pages with rule and rule_verdict; rules are (action, host, path).

    Of the fitting rules the longest holds; of equals that of the longer host, then the blocking one.
    """
    fits = lambda h, p: ((F.col(host) == h) | F.endswith(F.col(host), F.concat(F.lit("."), h))) & F.startswith(F.col(path), p)
    entry = lambda a, h, p: F.struct(
        (F.length(h) + F.length(p)).alias("size"), F.length(h).alias("h"), a.alias("action"), F.concat(h, p).alias("rule")
    )
    if len(rules) <= INLINE_RULES:
        found = F.array(*[F.when(fits(F.lit(h), F.lit(p)), entry(F.lit(a), F.lit(h), F.lit(p))) for a, h, p in rules])
        best = F.array_max(F.array_compact(found)) if rules else F.lit(None).cast("struct<size:int,h:int,action:string,rule:string>")
        ruled = pages.withColumn("__best", best)
    else:  # every suffix of a distinct host meets the rules of that host; their paths are tried then
        table = pages.sparkSession.createDataFrame(rules, "action string, on string, start string")
        by_host = table.groupBy("on").agg(F.collect_list(F.struct("action", "start")).alias("own"))
        labels = F.split(host, r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        hosts = pages.select(host).distinct().select(host, F.explode(tails).alias("on")).join(by_host, "on")
        hosts = hosts.groupBy(host).agg(F.collect_list(F.struct("on", "own")).alias("__rules"))
        tried = F.flatten(F.transform("__rules", lambda r: F.transform(
            F.filter(r["own"], lambda o: F.startswith(F.col(path), o["start"])), lambda o: entry(o["action"], r["on"], o["start"]))))
        ruled = pages.join(hosts, host, "left").withColumn("__best", F.array_max(tried)).drop("__rules")
    return ruled.select(
        *pages.columns, F.col("__best.rule").alias("rule"), F.col("__best.action").alias("rule_verdict")
    )


def _weight(groups: DataFrame) -> float:
    """Prior weight (in pages) of a level, by the moments of its groups (n, k, mean of the prior)."""
    p = F.col("k") / F.col("n")
    row = groups.agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (p - F.col("mean")) ** 2).alias("s"), F.sum(F.col("mean") * (1 - F.col("mean"))).alias("v"),
    ).first()
    if not row.g or not row.n or not row.v:
        return 1.0
    v = row.v / row.g
    between = (row.s - v * (row.g - 1)) / (v * max(row.n - row.nn / row.n - (row.g - 1), 1e-9))
    return 1 / min(max(between, 1e-3), 0.99) - 1


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, k, bad_rate, bad_bound): posterior mean and lower bound from rows (host, bad 0/1 or null)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = registered(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((total.k or 0) + 0.5) / ((total.n or 0) + 1)
    shrunk = lambda w: (F.col("mean") * w + F.col("k")) / (w + F.col("n"))

    by_suffix = suffixes.withColumn("mean", F.lit(base))
    w = _weight(by_suffix.where("n > 0"))
    by_domain = domains.join(by_suffix.select("suffix", shrunk(w).alias("mean")), "suffix")
    w = _weight(by_domain.where("n > 0"))
    by_host = hosts.join(by_domain.select("domain", shrunk(w).alias("mean")), "domain")
    w = _weight(by_host.where("n > 0"))
    rate, size = shrunk(w), w + F.col("n")
    bound = rate - z * F.sqrt(rate * (1 - rate) / (size + 1))
    return by_host.select("host", "n", "k", rate.alias("bad_rate"), F.greatest(bound, F.lit(0.0)).alias("bad_bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], most_bad: float = 0.2, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """pages with host, path, rule, verdict, bad_rate and bad_bound. outcomes: (id, bad 0/1)."""
    results = ["host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    host, path = url_parts(F.col(url_col))
    parts = without(pages, results).withColumns({"host": host, "path": path})
    known = outcomes.groupBy("id").agg(F.max("bad").alias("bad"))
    seen = parts.select(id_col, "host").join(known, F.col(id_col) == F.col("id"), "left")
    ruled = with_rules(parts, rules)
    joined = ruled.join(reputations(seen), "host", "left")
    own = F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")
    return joined.select(
        *[c for c in parts.columns], "rule", F.coalesce("rule_verdict", own).alias("verdict"), "bad_rate", "bad_bound"
    )


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return judged(pages, labels.select(F.col("doc_id").alias("id"), bad.alias("bad")), RULES).select(
        "page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound")
    )


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(action, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(h || s, (length(h) + length(s)) * 1000 + length(h)) AS rule, arg_max(action, (length(h) + length(s)) * 1000 + length(h)) AS action
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
h2 AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM h),
h3 AS (
  SELECT host, n, k, CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain,
         CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz') THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h3 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) FROM h3) AS mean FROM d GROUP BY suffix),
ws AS (SELECT %(weight)s AS w FROM s WHERE n > 0),
d2 AS (SELECT d.*, (s.mean * w + s.k) / (w + s.n) AS mean FROM d JOIN s USING (suffix), ws),
wd AS (SELECT %(weight)s AS w FROM d2 WHERE n > 0),
h4 AS (SELECT h3.*, (d2.mean * w + d2.k) / (w + d2.n) AS mean FROM h3 JOIN d2 USING (domain), wd),
wh AS (SELECT %(weight)s AS w FROM h4 WHERE n > 0),
rep AS (SELECT host, (mean * w + k) / (w + n) AS rate, w + n AS size FROM h4, wh),
rep2 AS (SELECT host, rate, greatest(rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (size + 1)), 0) AS bound FROM rep)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.action, CASE WHEN bound > 0.2 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM p JOIN rep2 USING (host) LEFT JOIN best USING (page_id)
""" % {
    "weight": "1 / least(greatest((sum(n * (k / n - mean) ** 2) - avg(mean * (1 - mean)) * (count(*) - 1))"
    " / (avg(mean * (1 - mean)) * greatest(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 1e-9)), 1e-3::DOUBLE), 0.99::DOUBLE) - 1"
}

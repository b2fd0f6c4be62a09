"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Rules decide first: a rule fits its host and all subdomains if the url's path
starts with the rule's path, and the longest rule wins.  Everything else is
judged by reputation.  A page's outcome is bad if the labelled document that
its url names is toxic or of low quality.  Outcomes are shrunk level by level
through beta-binomial priors: the corpus rate is the prior of a suffix, a
suffix's posterior mean that of its registered domains, a domain's that of its
hosts.  How strongly a level shrinks is estimated from the spread of its
groups (method of moments).  A host is blocked if a lower bound of its
posterior bad rate is above ``most_bad``.

Defined results: a null url or one without ``://`` has empty host and path and
is judged like any other host.  A url names the document whose number starts its
path's last segment (one slash may follow it); more than 18 digits count as
their first 18.  Hosts without outcomes have their domain's mean.  Several labels of one document: bad if one is.  Without outcomes the
rate is 0.5 with the widest prior.  Repeated rows get equal verdicts.  Only
``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, materialize

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Second-level names under which, with a country code, registered domains start one label further left.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
STRENGTH = (1.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as its text) and its verdict; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix: the last label, or the last two where a country code follows a
    known second-level name.  Domain: the suffix and one label more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    second = F.when(n >= 3, F.element_at(labels, -2))
    two = F.coalesce((F.length(F.element_at(labels, -1)) == 2) & second.isin(*SECOND_LEVEL), F.lit(False))
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1)), F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def named_document(path: Column) -> Column:
    """The number at the start of the path's last segment; null if none.

    The segment is cut off first: a pattern over all segments would recurse
    once a segment and end the JVM on a long path.
    """
    trimmed = F.when(F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    number = F.regexp_extract(F.substring_index(trimmed, "/", -1), r"^[0-9]{1,18}", 0)
    return F.when(F.startswith(trimmed, F.lit("/")) & (number != ""), number.cast("long"))


def strength(groups: DataFrame) -> tuple[float, float]:
    """Corpus rate, and the prior strength by the method of moments, of groups
    with ``n`` outcomes of which ``bad`` are bad.  Three sums reach the driver."""
    s = groups.where("n > 0").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2")).first()
    if not s["n"]:
        return 0.5, STRENGTH[0]
    rate = s["bad"] / s["n"]
    spread = s["b2"] - s["n"] * rate * rate  # sum of n (p - rate)^2
    room = rate * (1 - rate)
    free = s["n"] - s["n2"] / s["n"] - (s["k"] - 1)
    if room <= 0 or free <= 0:
        return rate, STRENGTH[1]
    rho = (spread - room * (s["k"] - 1)) / (room * free)
    return rate, min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1)) if rho > 0 else STRENGTH[1]


def judge_urls(pages: DataFrame, labels: DataFrame, *, rules=RULES, named=named_document, most_bad: float = 0.5, z: float = 1.645, hot: int = 1000) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate`` for each row.

    named: gives the id of the labelled document that a path names.  hot:
    hosts of more pages (or more than a 2000th of all) are dealt to several tasks.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    suffix, domain = suffix_and_domain(F.col("host"))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    # counted by host and document before the join, so a frequent host or document is one row a task
    visits = seen.groupBy("host", named(F.col("path")).alias("doc_id")).agg(F.count(F.lit(1)).alias("visits")).join(told, "doc_id", "left")
    known = F.when(F.col("bad").isNotNull(), F.col("visits")).otherwise(0)
    counts = visits.groupBy("host").agg(F.sum("visits").alias("pages"), F.sum(known).alias("n"), F.sum(known * F.coalesce("bad", F.lit(0))).alias("bad"))
    hosts = materialize(counts.select("host", suffix.alias("suffix"), domain.alias("domain"), "pages", "n", "bad"))
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (rate, of_suffix), (_, of_domain), (_, of_host) = (strength(x) for x in (suffixes, domains, hosts))
    mean = lambda k, prior: (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    by_suffix = suffixes.select("suffix", mean(of_suffix, F.lit(rate)).alias("p_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", mean(of_domain, F.col("p_suffix")).alias("p_domain"))
    by_host = hosts.join(by_domain, "domain").select("host", "pages", (F.col("n") + F.lit(of_host)).alias("weight"), mean(of_host, F.col("p_domain")).alias("bad_rate"))
    lower = F.col("bad_rate") - F.lit(z) * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("weight") + 1))
    by_host = by_host.select("host", "pages", "bad_rate", F.when(lower > most_bad, "block").otherwise("allow").alias("judged"))
    rule, ruled = rule_column(F.col("host"), F.col("path"), rules)
    judged = hot_join(seen, by_host, "host", "pages", max(hot, total // 2000), ["page_id", "path"])
    return judged.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", rule.alias("rule"), F.coalesce(ruled, "judged").alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))


#: The rows of judge_urls with its defaults, for DuckDB.
SQL = r"""
WITH split AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
told AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
named AS (SELECT host, CASE WHEN starts_with(p, '/') THEN TRY_CAST(nullif(regexp_extract(string_split(p, '/')[-1], '^[0-9]{1,18}', 0), '') AS BIGINT) END AS doc_id FROM (SELECT host, CASE WHEN ends_with(path, '/') THEN left(path, length(path) - 1) ELSE path END AS p FROM seen)),
outcomes AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM named JOIN told USING (doc_id) GROUP BY host),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM seen),
two AS (SELECT host, l, coalesce(len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac','co','com','edu','gov','net','org'), false) AS b FROM parts),
hosts AS (SELECT host, array_to_string(l[-(CASE WHEN b THEN 2 ELSE 1 END):], '.') AS suffix, array_to_string(l[-(CASE WHEN b THEN 3 ELSE 2 END):], '.') AS domain, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM two LEFT JOIN outcomes USING (host)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
levels AS (SELECT 1 AS level, n, bad FROM suffixes UNION ALL SELECT 2, n, bad FROM domains UNION ALL SELECT 3, n, bad FROM hosts),
sums AS (SELECT level, count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n::DOUBLE) AS b2 FROM levels WHERE n > 0 GROUP BY level),
rates AS (SELECT level, bad / n AS rate, (b2 - n * (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * (k - 1)) AS top, (bad / n) * (1 - bad / n) AS room, n - n2 / n - (k - 1) AS free FROM sums),
prior AS (SELECT level, rate, CASE WHEN room <= 0 OR free <= 0 OR top <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, room * free / top - 1)) END AS strength FROM rates),
given AS (SELECT max(rate) AS rate, max(strength) FILTER (level = 1) AS s1, max(strength) FILTER (level = 2) AS s2, max(strength) FILTER (level = 3) AS s3 FROM prior),
g AS (SELECT coalesce(rate, 0.5) AS rate, coalesce(s1, 1.0) AS s1, coalesce(s2, 1.0) AS s2, coalesce(s3, 1.0) AS s3 FROM given),
by_suffix AS (SELECT suffix, (bad + s1 * rate) / (n + s1) AS p FROM suffixes, g),
by_domain AS (SELECT domain, (d.bad + s2 * p) / (d.n + s2) AS p FROM domains d JOIN by_suffix USING (suffix), g),
by_host AS (SELECT host, h.n + s3 AS w, (h.bad + s3 * p) / (h.n + s3) AS r FROM hosts h JOIN by_domain USING (domain), g),
judged AS (SELECT host, r, CASE WHEN r - 1.645 * sqrt(r * (1 - r) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS j FROM by_host),
rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(h, p, v)),
pairs AS (SELECT DISTINCT host, path FROM seen),
fitting AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM pairs, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, s.host, s.path, rule, coalesce(v, j) AS verdict, round(r, 6) AS bad_rate FROM seen s JOIN judged USING (host) LEFT JOIN fitting f ON f.host = s.host AND f.path = s.path
"""

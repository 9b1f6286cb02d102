"""Empirical-Bayes reputation of hosts (DataFrame functions only)."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import save, table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the contract of the query.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]
#: Suffixes of more than one label under which domains are registered; a host's registered domain has one label more than its suffix. A parameter of judge(); these are common ones, one label stands for all others.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.ar", "co.in", "co.za")
#: A host is blocked if its share of bad pages is above THRESHOLD even at the lower bound, Z standard deviations under the posterior mean.
Z, THRESHOLD = 1.645, 0.5
#: Limits of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Columns rule and rule_verdict from host and path: the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumns({"rule": name, "rule_verdict": verdict})


def strength(groups: DataFrame, n: str, k: str, out: str) -> DataFrame:
    """One row: the strength of a beta prior over groups, by the moments of the beta-binomial law (analysis-of-variance estimator)."""
    n, k = F.col(n).cast("double"), F.col(k).cast("double")
    sums = groups.filter(n > 0).agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"), F.count(F.lit(1)).cast("double").alias("g"))
    between = (F.col("kk") - F.col("k") * F.col("k") / F.col("n")) / (F.col("g") - 1)
    within = (F.col("k") - F.col("kk")) / (F.col("n") - F.col("g"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("g") - 1)
    rho = F.try_divide(F.col("b") - F.col("w"), F.col("b") + (F.col("n0") - 1) * F.col("w"))
    got = sums.select(F.when((F.col("g") > 1) & (F.col("n") > F.col("g")), F.struct(between.alias("b"), within.alias("w"), n0.alias("n0"))).alias("x")).select("x.*")
    got = got.select(rho.alias("rho"))
    value = F.when(F.col("rho").isNull() | (F.col("rho") <= 1 / (STRONGEST + 1)), STRONGEST).when(F.col("rho") >= 1 / (WEAKEST + 1), WEAKEST).otherwise(1 / F.col("rho") - 1)
    return got.select(value.alias(out))


def reputations(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row a host: posterior mean and lower bound of its share of bad pages.

    pages has host and outcome (1 bad, 0 good, null unlabelled). Pages are summed by host first, so a
    host with a third of all pages is one row of a map-side sum. Counts then roll up to the registered
    domain and the suffix (one of suffixes, else the last label; a port counts for neither). Each level's mean is shrunk to that
    above by a prior whose strength comes from the spread of the level's own groups. Hosts without
    labels get their domain's, suffix' or the corpus' mean; without any label that is 1/2.
    """
    bare = F.regexp_replace("host", r":\d*$", "")
    last = lambda i: F.substring_index(bare, ".", -i)
    double = last(2).isin(*suffixes) if suffixes else F.lit(False)
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum(F.col("outcome").cast("long")), F.lit(0)).alias("k"))
    hosts = save(hosts.withColumns({"domain": F.when(double, last(3)).otherwise(last(2)), "suffix": F.when(double, last(2)).otherwise(last(1))}), "hosts")
    level = lambda by: hosts.groupBy(by).agg(F.sum("n").alias(f"n_{by}"), F.sum("k").alias(f"k_{by}"))
    domains, suffixes = save(level("domain"), "domains"), save(level("suffix"), "suffixes")
    root = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("m0")).first()["m0"]
    c = {by: strength(df, n, k, "c").first()["c"] for by, df, n, k in (("host", hosts, "n", "k"), ("domain", domains, "n_domain", "k_domain"), ("suffix", suffixes, "n_suffix", "k_suffix"))}
    shrunk = lambda k, n, c, to: (F.col(k) + F.lit(c) * to) / (F.col(n) + F.lit(c))
    out = hosts.join(domains, "domain").join(suffixes, "suffix")
    out = out.withColumn("m_suffix", shrunk("k_suffix", "n_suffix", c["suffix"], F.lit(root)))
    out = out.withColumn("m_domain", shrunk("k_domain", "n_domain", c["domain"], F.col("m_suffix")))
    out = out.withColumn("mean", shrunk("k", "n", c["host"], F.col("m_domain")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(c["host"]) + 1))
    return out.select("host", "n", "k", "mean", (F.col("mean") - Z * spread).alias("lower"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """All rows of pages (page_id, url, ...) with host, path, rule and verdict.

    Pages that a rule fits have the rule's verdict and serve as the labelled outcomes; others are
    blocked if their host's reputation is. Null or odd urls have an empty host, which is a host like any
    other. Repeated page_ids stay repeated. Columns named like the new ones are replaced.
    """
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = with_rule(rows, rules)
    known = rows.select("host", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0).alias("outcome"))
    blocked = save(reputations(known, suffixes).select("host", (F.col("lower") > THRESHOLD).alias("_blocked")), "reputations")
    own = F.when(F.col("_blocked"), "block").otherwise("allow")
    return rows.join(blocked, "host", "left").withColumn("verdict", F.coalesce("rule_verdict", own)).drop("_blocked", "rule_verdict")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with host, path, rule and verdict; null and odd urls have an empty host, repeated rows stay."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same for DuckDB."""
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(RULES, key=lambda r: -len(r.name))) + " END"

    def c(source: str, n: str, k: str) -> str:
        return f"""(SELECT CASE WHEN rho IS NULL OR rho <= 1 / ({STRONGEST}::DOUBLE + 1) THEN {STRONGEST}::DOUBLE WHEN rho >= 1 / ({WEAKEST}::DOUBLE + 1) THEN {WEAKEST}::DOUBLE ELSE 1 / rho - 1 END
          FROM (SELECT CASE WHEN g > 1 AND n > g AND b + (n0 - 1) * w <> 0 THEN (b - w) / (b + (n0 - 1) * w) END AS rho
          FROM (SELECT n, g, (kk - k * k / n) / nullif(g - 1, 0) AS b, (k - kk) / nullif(n - g, 0) AS w, (n - nn / n) / nullif(g - 1, 0) AS n0
          FROM (SELECT sum({n}::DOUBLE) AS n, sum({k}::DOUBLE) AS k, sum({n}::DOUBLE * {n}) AS nn, sum({k}::DOUBLE * {k} / {n}) AS kk, count(*)::DOUBLE AS g FROM {source} WHERE {n} > 0))))"""

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
    WITH cut AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS (SELECT *, {case("name")} AS rule, {case("verdict")} AS rule_verdict FROM cut),
    labels_of AS (SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l, rule_verdict FROM ruled),
    cut_hosts AS (SELECT host, l, rule_verdict, CASE WHEN array_to_string(l[-2:], '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN 2 ELSE 1 END AS s FROM labels_of),
    hosts AS (SELECT host, array_to_string(l[-1 - s:], '.') AS domain, array_to_string(l[-s:], '.') AS suffix,
        count(rule_verdict) AS n, count(*) FILTER (rule_verdict = 'block') AS k FROM cut_hosts GROUP BY ALL),
    domains AS (SELECT domain, sum(n) AS n_domain, sum(k) AS k_domain FROM hosts GROUP BY domain),
    suffixes AS (SELECT suffix, sum(n) AS n_suffix, sum(k) AS k_suffix FROM hosts GROUP BY suffix),
    params AS (SELECT (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) FROM hosts) AS m0, {c("hosts", "n", "k")} AS ch, {c("domains", "n_domain", "k_domain")} AS cd, {c("suffixes", "n_suffix", "k_suffix")} AS cs),
    means AS (SELECT host, n, ch, (k + ch * (k_domain + cd * (k_suffix + cs * m0) / (n_suffix + cs)) / (n_domain + cd)) / (n + ch) AS m
        FROM hosts JOIN domains USING (domain) JOIN suffixes USING (suffix) CROSS JOIN params),
    bad AS (SELECT host, m - {Z}::DOUBLE * sqrt(m * (1 - m) / (n + ch + 1)) > {THRESHOLD} AS blocked FROM means)
    SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM ruled JOIN bad USING (host)"""

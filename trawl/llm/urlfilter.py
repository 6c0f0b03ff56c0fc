"""URL filters: explicit rules first, then the host's reputation by empirical Bayes.

Labelled page outcomes are counted for each host, registered domain and suffix. Rates shrink from level to level:
the suffix towards the whole, the domain towards its suffix, the host towards its domain, each with a beta prior whose
strength is fitted by moments from how much rates differ on that level. A host is blocked if its posterior rate of
bad pages is over the limit even at the lower bound (mean less Z standard deviations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of two labels under which domains are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "com.mx", "co.za")
LIMIT, Z, LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1.645, 2.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def levels(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    return F.when(long, two).otherwise(F.substring_index(host, ".", -1)), F.when(long, F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def reputation(counts: DataFrame) -> DataFrame:
    """host, mean and lower bound of the posterior rate of bad pages. counts: host, suffix, domain, n, b."""

    def level(unit: str) -> DataFrame:
        return counts.groupBy(unit).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))

    def strength(units: DataFrame, name: str) -> DataFrame:
        # sum of n (r - p)^2 = sum of b^2 / n - B^2 / N, in one pass
        t = units.filter("n > 0").agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("N"), F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("B"), F.coalesce(F.sum(F.col("b") * F.col("b") / F.col("n")), F.lit(0.0)).alias("q"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("nn"))
        p = F.when(F.col("N") > 0, F.col("B") / F.col("N")).otherwise(F.lit(0.5))
        noise = p * (1 - p)
        spread = (F.round(F.col("q") - F.col("B") * p, 6) - (F.col("k") - 1) * noise) / (F.col("N") - F.col("nn") / F.col("N"))  # variance between units
        fitted = F.when((F.col("k") > 1) & (F.col("N") > F.col("nn") / F.col("N")) & (spread > 0), noise / spread - 1).otherwise(F.lit(MOST_STRENGTH))
        return t.select(F.round(F.least(F.greatest(fitted, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), 3).alias(f"s_{name}"), p.alias(f"p_{name}"))

    suffixes, domains = level("suffix"), level("domain")
    fits = strength(suffixes, "suffix").crossJoin(strength(domains, "domain").select("s_domain")).crossJoin(strength(counts, "host").select("s_host"))  # one row each
    out = counts.join(suffixes.select(F.col("suffix").alias("sx"), F.col("n").alias("sn"), F.col("b").alias("sb")), F.col("suffix") == F.col("sx")).join(domains.select(F.col("domain").alias("dx"), F.col("n").alias("dn"), F.col("b").alias("db")), F.col("domain") == F.col("dx"))
    out = out.crossJoin(F.broadcast(fits))  # one row
    out = out.withColumn("m1", (F.col("sb") + F.col("s_suffix") * F.col("p_suffix")) / (F.col("sn") + F.col("s_suffix")))
    out = out.withColumn("m2", (F.col("db") + F.col("s_domain") * F.col("m1")) / (F.col("dn") + F.col("s_domain")))
    out = out.withColumn("a", F.col("b") + F.col("s_host") * F.col("m2")).withColumn("z", F.col("n") - F.col("b") + F.col("s_host") * (1 - F.col("m2")))
    mean = F.col("a") / (F.col("a") + F.col("z"))
    sd = F.sqrt(F.col("a") * F.col("z") / ((F.col("a") + F.col("z")) * (F.col("a") + F.col("z")) * (F.col("a") + F.col("z") + 1)))
    return out.select("host", mean.alias("rate"), (mean - F.lit(Z) * sd).alias("lower_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, lower_bound of each row of pages (page_id, url).

    outcomes: page_id, bad (0 or 1; null and unmatched rows don't count; rows that repeat a page count each). A url
    that is null or has no :// has an empty host, which has a reputation like any other. The table of hosts is joined by
    host and by its hash, so adaptive execution may split a host with a large share of the pages.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col("page_id").alias("_page"), host.alias("host"), path.alias("path"))
    labelled = outcomes.filter("bad IS NOT NULL").groupBy(F.col("page_id").alias("_of")).agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    suffix, domain = levels(F.col("host"))
    counts = seen.join(labelled, F.col("_page") == F.col("_of"), "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    counts = counts.withColumn("suffix", suffix).withColumn("domain", domain)
    known = reputation(counts).select(F.col("host").alias("_host"), "rate", "lower_bound", F.xxhash64("host").alias("_k"))
    out = seen.withColumn("_h", F.xxhash64("host")).join(known, (F.col("host") == F.col("_host")) & (F.col("_h") == F.col("_k")), "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("lower_bound") > limit, "block").otherwise("allow")
    return out.select(F.col("_page").alias("page_id"), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "rate", "lower_bound")

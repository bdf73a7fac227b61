"""URL filters from rules and empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix. Each unit's rate shrinks towards the
one above through a beta-binomial prior whose strength is fitted by moments over all units of the level. A prior's mean is of the outcomes
outside the unit (a host's of the rest of its domain, a domain's of the rest of its suffix, a suffix's of all others), so none counts twice. A host
is blocked if the upper bound of its posterior good rate lies under `floor` times the overall rate: by default, if it is credibly worse than the whole; rules come first.

A null url or one without :// has host and path empty. Pages without outcome count for nothing but get verdicts; a repeated page counts as often
as it occurs. Of rules that fit, the longest wins, and of equally long ones the last by text. Urls of any length are read once. With no outcomes at all, only rules block. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch

#: Rules of the query: verdict, host, start of the path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of two labels under which domains are registered; all others have one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
FLOOR, Z = 1.0, 1.645


def host_of(url: Column) -> Column:
    """Host: after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Path: what follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Suffix and one label more."""
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def strength(units: DataFrame) -> tuple[float, float]:
    """Overall good rate, and the prior's strength by moments of units (good, n)."""
    at = F.sum(F.col("good") * F.col("good") / F.col("n"))
    r = units.where("n > 0").agg(F.count(F.lit(1)), F.sum("good"), F.sum("n"), at, F.sum(F.col("n") * F.col("n"))).first()
    k, good, n, squares, n2 = (float(x or 0) for x in r)
    if not n:
        return 0.5, 1.0
    m = good / n
    spread, base = squares - n * m * m, m * (1 - m)
    room = n - n2 / n - (k - 1)
    rho = (spread - (k - 1) * base) / (base * room) if base > 0 and room > 1e-9 else 1.0
    rho = min(max(rho, 1e-4), 0.5)
    return m, round(1 / rho - 1, 6)


def reputation(outcomes: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """(host, alpha, beta) posterior of each host in outcomes (host, good, n), and the overall rate."""
    hosts = scratch.save(outcomes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = scratch.save(hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    suffixes = scratch.save(domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    rate, s1 = strength(suffixes)
    (_, s2), (_, s3) = strength(domains), strength(hosts)
    whole = suffixes.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rest = lambda good, n, own, own_n, s, mean: (good - own + s * mean) / (n - own_n + s)
    others = F.lit(whole.n or 0) - F.col("n")
    suffixes = suffixes.select("suffix", F.col("good").alias("gs"), F.col("n").alias("ns"), F.when(others > 0, (F.lit(whole.good or 0) - F.col("good")) / others).otherwise(rate).alias("above"))
    above = rest(F.col("gs"), F.col("ns"), F.col("good"), F.col("n"), s1, F.col("above"))
    domains = domains.join(suffixes, "suffix").select("domain", F.col("good").alias("gd"), F.col("n").alias("nd"), above.alias("above"))
    mean = rest(F.col("gd"), F.col("nd"), F.col("good"), F.col("n"), s2, F.col("above"))
    found = hosts.join(domains, "domain").withColumn("mean", mean)
    return found.select("host", (F.col("good") + s3 * F.col("mean")).alias("alpha"), (F.col("n") - F.col("good") + s3 * (1 - F.col("mean"))).alias("beta")), rate


def upper(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Upper bound of a beta posterior: its mean and z deviations."""
    total = alpha + beta
    return alpha / total + z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def rules_of(host: Column, rules: tuple) -> Column:
    """The rules (length, rule, start, verdict) whose host is `host` or above it, longest first. Rules are parameters, not data."""
    known = F.array(*(F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(h).alias("at"), F.lit(p).alias("start"), F.lit(v).alias("verdict")) for v, h, p in rules))
    return F.sort_array(F.filter(known, lambda r: (host == r["at"]) | F.endswith(host, F.concat(F.lit("."), r["at"]))), asc=False)


def verdicts(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, floor: float = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict and upper bound of every page.

    outcomes: (page_id, good) with good 0 or 1; null outcomes are ignored. Pages meet the outcomes by id and one row for
    each host by host; both joins can be split by adaptive execution where one host holds many pages.
    """
    scratch = Scratch(pages.sparkSession, "urlrep")
    rows = scratch.save(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    seen = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    counted = rows.select("page_id", "host").join(seen, "page_id", "left").select("host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("n"))
    posterior, rate = reputation(counted, scratch)
    hosts = posterior.withColumn("bound", F.round(upper(F.col("alpha"), F.col("beta")), 9)).withColumn("rules", rules_of(F.col("host"), rules) if rules else F.lit(None))
    path = F.col("path")
    found = rows.join(hosts, "host").withColumn("fit", F.get(F.filter("rules", lambda r: F.startswith(path, r["start"])), F.lit(0)) if rules else F.lit(None))
    by_rate = F.when(F.col("bound") < round(floor * rate, 9), "block").otherwise("allow")
    if not rules:
        return found.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), by_rate.alias("verdict"), "bound")
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_rate).alias("verdict"), "bound")

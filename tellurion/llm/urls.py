"""URL filters by rules and empirical-Bayes host reputation, with DataFrame functions alone.

A rule names a host, with all its subdomains, and the start of a path; the longest that fits decides. Where none
does, the host's reputation decides. Labelled page outcomes are shrunk level by level: a suffix's bad rate towards the
global rate, a registered domain's towards its suffix, a host's towards its domain, each by a beta prior whose strength
is estimated from how far the children's counts scatter (moments of the beta-binomial). A host is blocked if the lower
bound of its posterior rate lies above one half.

Without labels of its own, a table's pages are labelled by the rules: the pages of every host that some rule addresses
count as reviewed, as bad if a rule blocks them. So a rule on one path of a host doesn't condemn the rest of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Labels that, before a country's two letters, belong to the public suffix.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "net", "nom", "or", "org")
#: Hosts that are addresses, of either version.
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$"

#: Lower and upper bound of the correlation of outcomes within a group.
LEAST, MOST = 0.001, 0.99
#: Quantile of the normal distribution for the posterior's lower bound, and what it must exceed for a block.
Z, LIMIT = 1.645, 0.5
#: Rules up to this number are one expression; more are joined by host.
INLINE = 64


def host(url: str | Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def domain_levels(name: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; user and port count for neither, and an IP address is both by itself."""
    bare = F.regexp_replace(F.regexp_replace(name, "(?s)^.*@", ""), ":[0-9]*$", "")
    address = bare.rlike(ADDRESS)
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    long = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND)
    k = F.when(long, 2).otherwise(1)

    def last(m: Column) -> Column:
        m = F.least(m, n)
        return F.when(address, bare).otherwise(F.array_join(F.slice(labels, n - m + 1, m), "."))

    return last(k + 1), last(k)


def _fits(rule_host: Column, rule_path: Column) -> Column:
    return ((F.col("host") == rule_host) | F.endswith(F.col("host"), F.concat(F.lit("."), rule_host))) & F.startswith(F.col("path"), rule_path)


def ranked(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, start of path), the one that decides first: the longest, of these the one that blocks, then by name."""
    parts = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    return sorted(parts, key=lambda x: (-len(x[1]), x[0] != "block", x[1]))


def match_rules(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``rows`` (with host and path) with rule, verdict and reviewed (some rule fits the host); ``rules`` are (verdict, "host/path").

    The longest rule decides; of equally long ones, one that blocks, then the smaller name. Many rules are joined to
    the distinct hosts and paths, by the hosts above each; up to ``INLINE`` are one expression. Both give the same.
    """
    parts = ranked(rules)
    if len(parts) <= INLINE:
        rule, verdict, reviewed = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
        for v, r, h, p in reversed(parts):
            fits = _fits(F.lit(h), F.lit(p))
            rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
            reviewed = reviewed | _fits(F.lit(h), F.lit(""))
        return rows.withColumns({"rule": rule, "verdict": verdict, "reviewed": reviewed})
    listed = rows.sparkSession.createDataFrame([(h, p, k, r, v) for k, (v, r, h, p) in enumerate(parts)], "at string, start string, rank int, name string, says string")
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = places.select("host", "path", F.explode(above).alias("at")).join(listed, "at")
    best = F.min(F.when(F.startswith("path", "start"), F.struct("rank", "name", "says"))).alias("best")
    found = near.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(best)
    both = rows.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return both.withColumns({"rule": F.col("best.name"), "verdict": F.col("best.says"), "reviewed": F.col("h").isNotNull()}).drop("best", "h", "p")


def _strength(children: DataFrame, mean: Column) -> float:
    """Prior weight, in pages, that makes the children's counts (n, k) scatter as they do around ``mean``.

    Where no child has two labelled pages nothing scatters, and the weight is the largest.
    """
    v = mean * (1 - mean)
    off = F.sum((F.col("k") - F.col("n") * mean) * (F.col("k") - F.col("n") * mean)) - F.sum(F.col("n") * v)
    rho = children.agg(F.try_divide(off, F.sum(F.col("n") * (F.col("n") - 1) * v)).alias("rho")).first()[0]
    return 1 / min(MOST, max(LEAST, rho or 0.0)) - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bound) of every host of ``outcomes`` (host, n, k: labelled pages and bad ones; n may be 0)."""
    domain, suffix = domain_levels(F.col("host"))
    hosts = cut(outcomes.withColumns({"domain": domain, "suffix": suffix}))
    seen = hosts.where("n > 0").agg(F.sum("k"), F.sum("n")).first()
    base = ((seen[0] or 0) + 0.5) / ((seen[1] or 0) + 1.0)

    def total(level: DataFrame, *by: str) -> DataFrame:
        return level.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(mean: Column, weight: float) -> Column:
        return (F.lit(weight) * mean + F.col("k")) / (F.lit(weight) + F.col("n"))

    suffixes = total(hosts, "suffix")
    suffixes = suffixes.select("suffix", shrunk(F.lit(base), _strength(suffixes, F.lit(base))).alias("mean"))
    domains = total(hosts, "suffix", "domain").join(suffixes, "suffix")
    domains = cut(domains.select("domain", "suffix", shrunk(F.col("mean"), _strength(domains, F.col("mean"))).alias("mean")))
    hosts = hosts.join(domains, ["domain", "suffix"])
    weight = _strength(hosts, F.col("mean"))
    a, b = F.lit(weight) * F.col("mean") + F.col("k"), F.lit(weight) * (1 - F.col("mean")) + F.col("n") - F.col("k")
    return hosts.select("host", (a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    ``outcomes`` (url, bad 0/1; null: not labelled) are labelled pages; without them the rules label the pages. Hosts
    without any labelled page stand as their domain and suffix do, or as all do. A null url, and one without ``://``,
    has an empty host and path and the reputation of the empty host. Rows are kept whole, repeated or not. Other
    columns are ignored; an empty table gives an empty result.
    """

    def parsed(rows: DataFrame, *names: str) -> DataFrame:
        return rows.select(*names, host("url").alias("host"), path("url").alias("path"))

    rows = match_rules(parsed(pages, "page_id"), rules)
    seen = rows.select("host", F.col("reviewed").cast("long").alias("n"), (F.col("reviewed") & F.coalesce(F.col("verdict") == "block", F.lit(False))).cast("long").alias("k"))
    if outcomes is not None:
        given = parsed(outcomes, "bad").select("host", F.when(F.col("bad").isNotNull(), 1).otherwise(0).cast("long").alias("n"), F.coalesce(F.col("bad").cast("long"), F.lit(0)).cast("long").alias("k"))
        seen = seen.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k")).unionByName(given)
    bounds = reputation(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    found = rows.join(bounds, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bound") > LIMIT, "block").otherwise("allow")).alias("verdict"))

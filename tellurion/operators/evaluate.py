"""Evaluation of a rule set on cases: what is wanted, what is found, and who fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Rule
from .scan import scan


def provider_rules(rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(provider, rule_id): the rules of each provider; those that ``overrides`` (provider, rule_id) lists have these alone."""
    own = rules.select(F.substring_index("rule_id", "__", 1).alias("provider"), "rule_id")
    if overrides is None:
        return own
    return own.join(overrides.select("provider").distinct(), "provider", "left_anti").unionByName(overrides.select("provider", "rule_id"))


def outcomes(cases: DataFrame, rules: list[Rule], providers: DataFrame) -> DataFrame:
    """``cases`` (provider, name, input, want array<string>) with found array<string> and outcome: pass, fail or skip.

    A case with wanted texts passes if each of them equals, is contained in, or contains a hit of the provider's rules;
    one with none (null or empty) passes if there is no such hit. Providers without rules are skipped. Names are unique
    within a provider.
    """
    hits = scan(cases, "input", rules, ["provider", "name"]).join(providers, ["provider", "rule_id"], "left_semi")
    found = hits.groupBy("provider", "name").agg(F.array_sort(F.collect_set("match")).alias("found"))
    known = providers.select("provider").distinct().withColumn("__known", F.lit(True))
    both = cases.join(found, ["provider", "name"], "left").join(known, "provider", "left")
    none = F.expr("cast(array() as array<string>)")
    want, got = F.coalesce("want", none), F.coalesce("found", none)
    met = F.forall(want, lambda w: F.exists(got, lambda h: (h == w) | F.contains(h, w) | F.contains(w, h)))
    passed = F.when(F.size(want) > 0, met).otherwise(F.size(got) == 0)
    outcome = F.when(F.col("__known").isNull(), "skip").when(passed, "pass").otherwise("fail")
    return both.select(*cases.columns, got.alias("found"), outcome.alias("outcome"))


def totals(outcome: DataFrame, by: str = "provider") -> DataFrame:
    """Passes, failures, skips and the share of passes, a row for each value of ``by``."""
    def n(what: str) -> Column:
        return F.count(F.when(F.col("outcome") == what, 1))

    share = F.round(n("pass") / F.nullif(n("pass") + n("fail"), F.lit(0)), 6)
    return outcome.groupBy(by).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("skip").alias("skipped"), share.alias("share"))


def clean_providers(outcome: DataFrame) -> DataFrame:
    return totals(outcome).where((F.col("failed") == 0) & (F.col("passed") > 0)).select("provider")


def failures(outcome: DataFrame, n: int = 3) -> DataFrame:
    """Each provider's first n failures by name, and how many there are besides."""
    w = Window.partitionBy("provider")
    bad = outcome.where("outcome = 'fail'")
    counts = bad.groupBy("provider").agg(F.count("*").alias("all"))
    first = bad.withColumn("k", F.row_number().over(w.orderBy("name"))).where(F.col("k") <= n)
    return first.join(counts, "provider").select("provider", "name", "k", F.greatest(F.col("all") - n, F.lit(0)).alias("more"))


def distinct_failures(outcome: DataFrame, *by: str) -> DataFrame:
    """Failures that several formats share, once."""
    return outcome.where("outcome = 'fail'").dropDuplicates(list(by))


def byte_offset(text: str | Column, characters: str | Column) -> Column:
    """Offset in bytes of an offset in code points."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.col(characters) if isinstance(characters, str) else characters
    return F.octet_length(F.substring(c, F.lit(1), n))

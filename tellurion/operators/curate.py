"""Curation of rule tables: which rules are active, and which prove noisy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import LITERAL_RUN, PROXIMITY, SPARED, Rule
from .hits import over_bounds
from .scan import count_hits


def provider(rule_id: str | Column = "rule_id") -> Column:
    return F.substring_index(rule_id, "__", 1)


def value_part(pattern: str | Column = "pattern") -> Column:
    """What follows a keyword window, else what follows a leading ``(?i)``."""
    c = F.col(pattern) if isinstance(pattern, str) else pattern
    window = PROXIMITY.pattern
    return F.when(F.rlike(c, F.lit(f"(?s){window}")), F.regexp_replace(c, f"(?s)^.*?{window}", "")).otherwise(F.regexp_replace(c, r"^\(\?i\)", ""))


def has_literal(value: Column) -> Column:
    bare = value
    for part in (r"(?s)\\.", r"\[[^\]]*\]", r"\{[^}]*\}"):
        bare = F.regexp_replace(bare, part, " ")
    return F.rlike(bare, F.lit(f"[A-Za-z0-9]{{{LITERAL_RUN}}}"))


def structural(rules: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Rules of a quarantined rule's provider whose value has no literal; ``quarantine`` has a rule_id column."""
    loud = quarantine.select(provider().alias("__provider")).distinct()
    shaped = rules.where(~F.col("rule_id").isin(*SPARED) & ~has_literal(value_part()))
    return shaped.join(loud, provider() == F.col("__provider"), "left_semi")


def active(rules: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Rules that are neither listed in the quarantine nor structural noise."""
    out = quarantine.select("rule_id").unionByName(structural(rules, quarantine).select("rule_id")).distinct()
    return rules.join(out, "rule_id", "left_anti").select(*rules.columns)


def with_jwt(rules: DataFrame, jwt: DataFrame) -> DataFrame:
    """``rules`` with the JWT detector in place of all JWT rules."""
    return rules.where((F.col("rule_id") != "jwt_token") & ~F.startswith("rule_id", F.lit("jwt__"))).unionByName(jwt)


def counts(rules: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: how many rules there are, are quarantined by id, by shape, and are active."""
    by_shape = structural(rules, quarantine).select("rule_id").distinct().withColumn("by_shape", F.lit(True))
    listed = quarantine.select("rule_id").distinct().withColumn("listed", F.lit(True))
    marked = rules.join(listed, "rule_id", "left").join(by_shape, "rule_id", "left")
    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    listed, shape = F.col("listed").isNotNull(), F.col("by_shape").isNotNull()
    return marked.agg(F.count("*").alias("total"), n(listed).alias("explicit"), n(shape).alias("structural"), n(~listed & ~shape).alias("active"))


def noisy(corpus: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """(rule_id, n, bytes) of the rules that a corpus without secrets shows to be noise: a quarantine made by measurement."""
    return over_bounds(count_hits(corpus, column, rules))


def duplicate_ids(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1")

"""The supplied tables with tokens planted in them, and the rule sets that queries run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Rule

#: Tokens go into the rows whose id is a multiple of this.
EVERY = 7

#: Personal data and one secret, as a rule file would have them.
CUSTOM = [
    Rule("assigned_token", r'token = "([0-9a-f]{40})"', 1, 3.0),
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    Rule("phone", r"\(\d{3}\) \d{3}-\d{4}"),
    Rule("card", r"\b(?:\d[ -]?){12,15}\d\b"),
]

#: Rules in the shape of extracted ones: noisy ones, a neighbour of theirs, and sound ones.
SHAPED = [
    Rule("demo__idpat", r"([a-z]{5,9})", 1),
    Rule("demo__keypat", r"(?i:demo)(?:.|[\n\r]){0,40}?\b([0-9a-z]{32})\b", 1),
    Rule("demo__hostpat", r"\b([a-z0-9-]+\.demo\.example)\b", 1),
    Rule("plain__userpat", r"([A-Z][a-z]{3,7})", 1),
    Rule("plain__secretpat", r"(?i)plain[:=]([A-Za-z0-9]{24})", 1),
    Rule("sound__keypat", r"\b(snd_[A-Za-z0-9]{30})\b", 1),
    Rule("sound__oldpat", r"(?i:sound)(?:.|[\n\r]){0,40}?\b([a-f0-9]{40})\b", 1),
    Rule("okta__tokenpat", r"\b00[a-zA-Z0-9_-]{40}\b"),
    Rule("okta__domainpat", r"([a-z0-9-]{1,40})", 1),
    Rule("jwt__keypat", r"\b(ey[a-zA-Z0-9]{34})\b", 1),
]
LOUD = ["demo__idpat", "plain__userpat", "okta__domainpat"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token(number: Column) -> Column:
    """A token of the classic kind, from a number."""
    digits = F.concat(F.md5(number.cast("string")), F.md5((number + 1).cast("string")))
    return F.concat(F.lit("gh"), F.lit("p_"), F.substring(digits, 1, 36))


def planted(rows: DataFrame, number: str, text: str = "text") -> DataFrame:
    """``rows`` with a token at the end of the text of each whose number is a multiple of EVERY."""
    n = F.col(number)
    return rows.withColumn(text, F.when(n % EVERY == 0, F.concat(F.col(text), F.lit(" GH="), token(n))).otherwise(F.col(text)))


def planted_sql(table: str, number: str, text: str = "text") -> str:
    """The same in SQL, as a subquery."""
    made = f"concat({text}, ' GH=', 'gh', 'p_', substr(concat(md5(cast({number} AS VARCHAR)), md5(cast({number} + 1 AS VARCHAR))), 1, 36))"
    return f"(SELECT * REPLACE (CASE WHEN {number} % {EVERY} = 0 THEN {made} ELSE {text} END AS {text}) FROM {table})"

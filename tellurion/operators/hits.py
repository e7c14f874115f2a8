"""Reports over a table of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a sample that are shown.
SHOWN = 120
#: Noise bounds of a rule over a corpus without secrets.
MAX_HITS, MAX_BYTES = 10, 1024
#: Of the corpus, one byte in this many may be overwritten.
MAX_SHARE = 1000


def per_rule(hits: DataFrame, *by: str) -> DataFrame:
    """(rule_id, ..., n, bytes): hits and their bytes; bytes that two hits share count twice."""
    return hits.groupBy("rule_id", *by).agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def ranked(stats: DataFrame, by_bytes: bool = False) -> DataFrame:
    """Rules by falling number of hits, then id; or by falling bytes, then hits. One row a rule: they fit one task."""
    order = [F.desc("bytes"), F.desc("n"), F.asc("rule_id")] if by_bytes else [F.desc("n"), F.asc("rule_id")]
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def samples(hits: DataFrame, n: int, key: str) -> DataFrame:
    """The first n hits of each rule, by ``key``, offset and length, with the number that isn't shown. Only n a rule and task are shuffled."""
    w = Window.partitionBy("rule_id").orderBy(key, "offset", "len")
    first = hits.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= n)
    counts = per_rule(hits).select("rule_id", "n")
    return first.join(counts, "rule_id").select("rule_id", "sample", key, "offset", "len", rendered("match").alias("shown"), F.greatest(F.col("n") - n, F.lit(0)).alias("more"))


def rendered(match: str | Column) -> Column:
    """The first SHOWN bytes of a match, printable ASCII as it is and other bytes as \\xNN, and how many bytes there are besides."""
    raw = F.encode(match, "UTF-8")
    view = F.decode(F.substring(raw, 1, SHOWN), "ISO-8859-1")
    chars = F.transform(F.filter(F.split(view, ""), lambda c: c != ""), lambda c: F.when((c >= " ") & (c <= "~"), c).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.encode(c, "ISO-8859-1")), 2, "0")))))
    rest = F.octet_length(raw) - SHOWN
    return F.concat(F.array_join(chars, ""), F.when(rest > 0, F.concat(F.lit(" [+"), rest.cast("string"), F.lit(" bytes]"))).otherwise(F.lit("")))


def over_bounds(stats: DataFrame, hits: int = MAX_HITS, size: int = MAX_BYTES) -> DataFrame:
    """Rules that hit more often, or more bytes, than text without secrets allows."""
    return stats.where((F.col("n") > hits) | (F.col("bytes") > size))


def audit(stats: DataFrame, corpus_bytes: int) -> DataFrame:
    """One row, from counts per rule: total hits, overwritten bytes, the cap on them, and whether it holds."""
    cap = F.lit(corpus_bytes // MAX_SHARE).cast("long")
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("overwritten"))
    return total.select("n", "overwritten", cap.alias("cap"), (F.col("overwritten") <= cap).alias("within"))


def origin_text(origin: str | Column) -> Column:
    """An origin struct as text."""
    return F.to_json(origin)

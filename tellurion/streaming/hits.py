"""Scans of streams: an extension, on the same stateless scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import scrub_text
from ..operators.scan import scan
from ..plans.rules import Rule


def hourly_hits(rows: DataFrame, time: str, column: str, rules: list[Rule], late: str = "1 hour") -> DataFrame:
    """(hour, rule_id, n) of the hits in a table or a stream; a stream's hours close when the watermark, ``late`` behind, passes."""
    found = scan(rows.withWatermark(time, late) if rows.isStreaming else rows, column, rules, [time])
    if rows.isStreaming:
        found = found.withWatermark(time, late)
    counts = found.groupBy(F.window(time, "1 hour").alias("w"), "rule_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("hour"), "rule_id", "n")


def scrub_stream(rows: DataFrame, column: str, rules: list[Rule], folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's rows, scrubbed, as Parquet; all that is there, then it stops."""
    return scrub_text(rows, column, rules).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Redaction of hits, which never changes a value's length."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO, PATTERN, DROP = "zero_fill", "pattern", "drop"


class RedactionError(ValueError):
    """A hit that can't be redacted."""


def apply_hits(data: bytes, hits: list[tuple[int, int]], kind: str = ZERO, pattern: bytes = b"") -> bytes:
    """The data with each (offset, length) overwritten, one after the other, by zeros or by the pattern, repeated."""
    out = bytearray(data)
    if kind == DROP:
        raise RedactionError("a flat value can't lose bytes")
    if kind == PATTERN and not pattern:
        raise RedactionError("the pattern is empty")
    for at, size in hits:
        if at < 0 or size < 0 or at + size > len(out):
            raise RedactionError(f"hit {at}..{at + size} lies outside of {len(out)} bytes")
        out[at : at + size] = bytes(size) if kind == ZERO else (pattern * (size // len(pattern) + 1))[:size]
    return bytes(out)


def redact_native(content: str | Column, hits: str | Column, kind: str = ZERO, pattern: bytes = b"") -> Column:
    """The same over a binary column and an array of structs with offset and len, in built-in functions alone."""
    if kind == DROP:
        return F.raise_error(F.lit("a flat value can't lose bytes")).cast("binary")
    if kind == PATTERN and not pattern:
        return F.raise_error(F.lit("the pattern is empty")).cast("binary")
    c = F.col(content) if isinstance(content, str) else content
    size = F.octet_length(c)
    unit = "00" if kind == ZERO else pattern.hex()
    width = len(unit) // 2

    def put(acc: Column, h: Column) -> Column:
        n = h["len"].cast("int")
        fill = F.unhex(F.substring(F.repeat(F.lit(unit), (n / width).cast("int") + 1), F.lit(1), 2 * n))
        outside = (h["offset"] < 0) | (n < 0) | (h["offset"] + n > size)
        return F.when(outside, F.raise_error(F.lit("a hit lies outside of its value")).cast("binary")).when(n == 0, acc).otherwise(F.overlay(acc, fill, (h["offset"] + 1).cast("int"), n))

    return F.when(F.size(hits) > 0, F.aggregate(hits, c, put)).otherwise(c)


def redact_column(rows: DataFrame, column: str, hits: str, out: str = "redacted", kind: str = ZERO, pattern: bytes = b"") -> DataFrame:
    """``rows`` with a column that has the hits of ``hits`` (array of structs with offset and len) overwritten.

    Text columns come back as text; zero fill puts NUL characters there. Values without hits are passed on as they are.
    """
    binary = isinstance(rows.schema[column].dataType, T.BinaryType)
    content = F.col(column) if binary else F.col(column).cast("binary")
    done = redact_native(content, hits, kind, pattern)
    return rows.withColumn(out, done if binary else done.cast("string"))


def redact_joined(rows: DataFrame, key: str, column: str, hits: DataFrame, kind: str = ZERO, pattern: bytes = b"") -> DataFrame:
    """``rows`` with ``column`` redacted by a separate table of hits (key, offset, len); rows without hits stay as they are."""
    grouped = hits.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("offset", "len"))).alias("__hits"))
    joined = rows.join(grouped, F.col(key) == F.col("__key"), "left")
    return redact_column(joined.withColumn("__hits", F.coalesce("__hits", F.expr("cast(array() as array<struct<offset:bigint,len:bigint>>)"))), column, "__hits", column, kind, pattern).select(*rows.columns)


def scrub_text(rows: DataFrame, column: str, rules: list, kind: str = ZERO, pattern: bytes = b"") -> DataFrame:
    """``rows`` with every hit of the rules in a text column overwritten, in one pass and without a shuffle."""
    from ..plans.matcher import compiled
    from ..plans.parallel import spread
    from ..plans.rules import dump, validate

    validate(rules)
    dumped = dump(rules)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        matcher = compiled(dumped)

        def one(text: str | None) -> str | None:
            found = matcher.scan_text(text) if text else []
            return apply_hits(text.encode(), [(a, n) for _, a, n in found], kind, pattern).decode("utf-8", "replace") if found else text

        return pa.array([one(t.as_py()) for t in texts], pa.string())

    return spread(rows).withColumn(column, clean(F.col(column)))


def invariants(before: Column, after: Column) -> Column:
    """True where a redacted value kept its length."""
    return F.octet_length(before) == F.octet_length(after)



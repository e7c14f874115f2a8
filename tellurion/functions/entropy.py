"""Shannon entropy in bits per byte."""

from __future__ import annotations

from collections import Counter
from math import log2

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon(data: bytes) -> float:
    """Of a byte string; 0 for an empty one."""
    n = len(data)
    return abs(sum(c / n * log2(c / n) for c in Counter(data).values())) if n else 0.0


def shannon_entropy(text: str | Column) -> Column:
    """Of a text column whose characters are bytes (ASCII, or an ISO-8859-1 view), without leaving the JVM; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.length(c)

    def term(acc: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(c, ch, F.lit("")))) / n
        return acc + p * F.log2(p)

    chars = F.array_distinct(F.split(c, ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.abs(F.aggregate(F.filter(chars, lambda x: x != ""), F.lit(0.0), term)))

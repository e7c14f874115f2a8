"""Scans of text and binary columns for hits of a rule set."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.dialect import to_java, to_python
from ..plans.matcher import compiled
from ..plans.parallel import spread
from ..plans.prefilter import DIGIT, literals
from ..plans.rules import Rule, dump, validate

HIT = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("len", T.LongType()),
        T.StructField("match", T.StringType()),
    ]
)

#: Marks that stand for the ends of a match while native spans are cut out.
OPEN, CLOSE = "\u0001", "\u0002"
#: More rules than this make a plan too large to compile well.
NATIVE_RULES = 30


def scan(rows: DataFrame, column: str, rules: list[Rule], keep: list[str], prefilter: bool = True) -> DataFrame:
    """One row per hit in a text or binary column: the columns ``keep``, then rule order and id, byte offset, length and match.

    Rules run in order over each value, behind a literal pre-filter; values are scanned whole, where they lie, and
    nothing is shuffled. Nulls have no hits. The match of a binary column is decoded with replacement characters.
    """
    validate(rules)
    dumped = dump(rules)
    ids = [r.rule_id for r in rules]
    names = [f"__{i}" for i in range(len(keep))]
    binary = isinstance(rows.schema[column].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = compiled(dumped, prefilter)
        for b in batches:
            at, hits, match = [], [], []
            for i, value in enumerate(b.column("__value")):
                data = value.as_py()
                if not data:
                    continue
                found = matcher.scan_bytes(data) if binary else matcher.scan_text(data)
                if found:
                    raw = data if binary else data.encode()
                    at += [i] * len(found)
                    hits += found
                    match += [raw[a : a + n].decode("utf-8", "replace") for _, a, n in found]
            if at:
                rule, offset, size = zip(*hits)
                take = pa.array(at, pa.int64())
                cols = {n: b.column(n).take(take) for n in names}
                cols |= {
                    "ord": pa.array(rule, pa.int32()),
                    "rule_id": pa.array([ids[k] for k in rule], pa.string()),
                    "offset": pa.array(offset, pa.int64()),
                    "len": pa.array(size, pa.int64()),
                    "match": pa.array(match, pa.string()),
                }
                yield pa.RecordBatch.from_pydict(cols)

    given = rows.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(column).alias("__value"))
    schema = T.StructType([T.StructField(n, rows.schema[c].dataType) for c, n in zip(keep, names)] + HIT.fields)
    found = spread(given).mapInArrow(run, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *HIT.names)


def count_hits(rows: DataFrame, column: str, rules: list[Rule], by: list[str] | None = None) -> DataFrame:
    """(by, rule_id, n, bytes): hits of a text or binary column per rule, counted where they are found, so that no hit leaves its task."""
    validate(rules)
    dumped, by = dump(rules), by or []
    names = [f"__{i}" for i in range(len(by))]
    binary = isinstance(rows.schema[column].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = compiled(dumped)
        for b in batches:
            counts: dict[tuple, list[int]] = {}
            keys = list(zip(*(b.column(n).to_pylist() for n in names))) if names else [()] * b.num_rows
            for key, value in zip(keys, b.column("__value")):
                data = value.as_py()
                if data:
                    for k, n, size in ((k, 1, size) for k, _, size in matcher.scan_bytes(data)) if binary else matcher.count_text(data):
                        entry = counts.setdefault((*key, k), [0, 0])
                        entry[0] += n
                        entry[1] += size
            if counts:
                cols = {n: pa.array([key[i] for key in counts], b.column(n).type) for i, n in enumerate(names)}
                cols |= {"rule_id": pa.array([matcher.rules[key[-1]].rule_id for key in counts], pa.string())}
                cols |= {n: pa.array([c[i] for c in counts.values()], pa.int64()) for i, n in enumerate(("n", "bytes"))}
                yield pa.RecordBatch.from_pydict(cols)

    given = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col(column).alias("__value"))
    schema = T.StructType([T.StructField(n, rows.schema[c].dataType) for c, n in zip(by, names)] + [T.StructField("rule_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bytes", T.LongType())])
    found = spread(given).mapInArrow(run, schema).groupBy(*names, "rule_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return found.select(*(F.col(n).alias(c) for c, n in zip(by, names)), "rule_id", "n", "bytes")


def scan_udf(rules: list[Rule], prefilter: bool = True):  # noqa: ANN201
    """A column function: the hits of a text column as an array, beside the row."""
    validate(rules)
    dumped = dump(rules)

    @F.arrow_udf(T.ArrayType(HIT))
    def hits(texts: pa.Array) -> pa.Array:
        matcher = compiled(dumped, prefilter)
        out = []
        for value in texts:
            text = value.as_py()
            raw = (text or "").encode()
            out.append(None if text is None else [{"ord": k, "rule_id": matcher.rules[k].rule_id, "offset": a, "len": n, "match": raw[a : a + n].decode("utf-8", "replace")} for k, a, n in matcher.scan_text(text)])
        kind = pa.list_(pa.struct([("ord", pa.int32()), ("rule_id", pa.string()), ("offset", pa.int64()), ("len", pa.int64()), ("match", pa.string())]))
        return pa.array(out, kind)

    return hits


def bytes_view(column: str | Column) -> Column:
    """A text whose characters are the bytes of the column's UTF-8."""
    return F.decode(F.encode(column, "UTF-8"), "ISO-8859-1")


def text_of(view: Column) -> Column:
    """Back from the view of bytes."""
    return F.decode(F.encode(view, "ISO-8859-1"), "UTF-8")


def spans(column: str | Column, rule: Rule, before: str = "", after: str = "") -> Column:
    """Array of (offset, len, match) of one rule's matches, in bytes, from built-in functions alone.

    The matches are put between marks, the text is split at them, and offsets are the lengths of what comes before. With
    ``before`` and ``after``, patterns without groups, only what the rule matches between them is a hit.
    """
    view = F.translate(bytes_view(column), OPEN + CLOSE, "\u0000\u0000")
    marked = F.regexp_replace(view, f"{to_java(f'({before})({rule.pattern})({after})')}", f"$1{OPEN}$2{CLOSE}$3")
    parts = F.split(marked, OPEN)
    state = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.struct(F.length(F.element_at(parts, 1)).cast("long").alias("at"), F.expr("cast(array() as array<struct<offset:bigint,len:bigint,match:string>>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) - 1).cast("long").alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("offset"), F.length(F.substring_index(p, CLOSE, 1)).cast("long").alias("len"), text_of(F.substring_index(p, CLOSE, 1)).alias("match")))).alias("out"),
        ),
    )
    return F.when(_may_match(F.col(column) if isinstance(column, str) else column, rule), state["out"])


def _may_match(text: Column, rule: Rule) -> Column:
    """False for nulls and texts without any literal that the rule needs."""
    needed = literals(to_python(rule.pattern))
    if not needed:
        return text.isNotNull()
    folded = F.lower(text)
    tests = [F.rlike(text, F.lit(r"[0-9]")) if x == DIGIT else F.contains(folded, F.lit(x)) for x in sorted(needed)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def scan_native(rows: DataFrame, column: str, rules: list[Rule], keep: list[str]) -> DataFrame:
    """As ``scan`` for a few whole-match rules, without leaving the JVM; entropy floors and the JWT filter hold.

    ``\\b``, ``\\w`` and ``\\d`` see bytes here, so beside letters beyond ASCII the two may differ.
    """
    from ..functions.entropy import shannon_entropy
    from ..functions.tokens import is_kept_jwt

    if len(rules) > NATIVE_RULES or any(r.capture_index for r in rules):
        raise ValueError(f"scan_native takes up to {NATIVE_RULES} rules without capture groups")
    validate(rules)
    each = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.min_entropy).cast("double").alias("floor"), F.lit(r.filter or "").alias("filter"), spans(column, r).alias("spans")) for k, r in enumerate(rules)))
    found = spread(rows.select(*keep, column) if column not in keep else rows.select(*keep)).select(*keep, F.explode(each).alias("r")).select(*keep, "r.ord", "r.rule_id", "r.floor", "r.filter", F.explode("r.spans").alias("s"))
    fine = (F.col("floor").isNull() | (shannon_entropy("s.match") >= F.col("floor"))) & ((F.col("filter") != "jwt") | is_kept_jwt("s.match"))
    return found.where(fine).select(*keep, "ord", "rule_id", "s.offset", "s.len", "s.match")

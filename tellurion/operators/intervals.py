"""Joins and merges of byte intervals: hits with members, cells, bodies and secrets. A null ``by`` is a value like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block; intervals meet by the blocks that they touch.
BLOCK = 1 << 16
#: Numbers of a stretch over which sums run in one task.
STRETCH = 1 << 16


def linearise(members: DataFrame, by: str, order: str, span: str = "span", base: str = "base", width: int = STRETCH) -> DataFrame:
    """``members`` with the running sum of the spans before each, within ``by`` and in the order of the number ``order``.

    The sums run over stretches of ``width`` numbers, and over the stretches' totals: a large group is many tasks' work.
    """
    rows = members.withColumn("__stretch", F.floor(F.col(order) / width))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(span).over(before.partitionBy(by, "__stretch").orderBy(order)), F.lit(0))
    totals = rows.groupBy(F.col(by).alias("__by"), F.col("__stretch").alias("__at")).agg(F.sum(span).alias("__sum"))
    totals = totals.select("__by", "__at", F.coalesce(F.sum("__sum").over(before.partitionBy("__by").orderBy("__at")), F.lit(0)).alias("__before"))
    both = rows.withColumn("__inner", inner).join(totals, F.col(by).eqNullSafe(F.col("__by")) & F.col("__stretch").eqNullSafe(F.col("__at")))
    return both.select(*members.columns, (F.col("__before") + F.col("__inner")).alias(base))


def _blocks(start: Column, end: Column, block: int) -> Column:
    """The blocks that an interval touches; an empty one touches the block that it lies in."""
    return F.sequence(F.floor(start / block), F.floor(F.greatest(start, end - 1) / block))


def route(hits: DataFrame, members: DataFrame, by: str, order: str, block: int = BLOCK) -> DataFrame:
    """``hits`` (by, offset, len) with the first member (by, order, base, span) that contains each, and the offset in it.

    An equi-join on by and the block of the hit's start; members are dealt to every block that they touch. Hits outside
    of all members are left out; ``unrouted`` has them.
    """
    m = members.where("span > 0").select(F.col(by).alias("__by"), F.col(order).alias("member"), F.col("base").alias("__base"), F.col("span").alias("__span"))
    m = m.withColumn("__block", F.explode(_blocks(F.col("__base"), F.col("__base") + F.col("__span"), block)))
    h = hits.withColumn("__at", F.floor(F.col("offset") / block))
    inside = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__at") == F.col("__block")) & (F.col("offset") >= F.col("__base")) & (F.col("offset") + F.col("len") <= F.col("__base") + F.col("__span"))
    found = h.join(m, inside)
    keys = [c for c in hits.columns]
    return found.groupBy(*keys).agg(F.min(F.struct("member", "__base")).alias("m")).select(*keys, F.col("m.member").alias("member"), (F.col("offset") - F.col("m.__base")).alias("inner_offset"))


def unrouted(hits: DataFrame, members: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """``hits`` that lie in no member: redacting them would touch structure."""
    m = members.where("span > 0").select(F.col(by).alias("__by"), F.col("base").alias("__base"), F.col("span").alias("__span"))
    m = m.withColumn("__block", F.explode(_blocks(F.col("__base"), F.col("__base") + F.col("__span"), block)))
    inside = F.col(by).eqNullSafe(F.col("__by")) & (F.floor(F.col("offset") / block) == F.col("__block")) & (F.col("offset") >= F.col("__base")) & (F.col("offset") + F.col("len") <= F.col("__base") + F.col("__span"))
    return hits.join(m, inside, "left_anti")


def guard(hits: DataFrame, members: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """``hits``, failing the query if one lies in no member; members don't overlap."""
    m = members.where("span > 0").select(F.col(by).alias("__by"), F.col("base").alias("__base"), F.col("span").alias("__span"), F.lit(True).alias("__in"))
    m = m.withColumn("__block", F.explode(_blocks(F.col("__base"), F.col("__base") + F.col("__span"), block)))
    inside = F.col(by).eqNullSafe(F.col("__by")) & (F.floor(F.col("offset") / block) == F.col("__block")) & (F.col("offset") >= F.col("__base")) & (F.col("offset") + F.col("len") <= F.col("__base") + F.col("__span"))
    found = hits.join(m, inside, "left")
    return found.where(F.assert_true(F.col("__in").isNotNull(), "a hit lies outside of every body").isNull()).select(*hits.columns)


def uncovered(secrets: DataFrame, hits: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """``secrets`` (by, start, end) that no hit (by, offset, len) overlaps: leaks. Equal rows stay or go together; each input is read once."""
    one = secrets.groupBy(*secrets.columns).agg(F.count("*").cast("int").alias("__n"))
    s = one.withColumn("__block", F.explode_outer(_blocks(F.col("start"), F.col("end"), block)))
    h = hits.select(F.col(by).alias("__by"), F.col("offset").alias("__at"), (F.col("offset") + F.col("len")).alias("__to"))
    h = h.withColumn("__hit", F.explode(_blocks(F.col("__at"), F.col("__to"), block)))
    over = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__hit")) & (F.col("__at") < F.col("end")) & (F.col("__to") > F.col("start"))
    blocks = s.join(h, over, "left").groupBy(*secrets.columns).agg(F.first("__n").alias("__n"), F.count("__at").alias("__touched"))
    return blocks.where("__touched = 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*secrets.columns)


def merged(hits: DataFrame, by: str) -> DataFrame:
    """(by, start, end, n): overlapping and touching hits of a value as one interval each."""
    w = Window.partitionBy(by).orderBy("offset", "len")
    reach = F.max(F.col("offset") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("__new", (reach.isNull() | (F.col("offset") > reach)).cast("int"))
    marked = marked.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(by, "__group").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("len")).alias("end"), F.count("*").alias("n"))
    return out.drop("__group")

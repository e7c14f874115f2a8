"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

Targets: the sources, by code point and null last, weigh 5, 2, 1, repeating, and share a budget; no target exceeds
``MOST`` times its source, and what is over is shared out again by weight (water filling over the sources' table).

Rates: of all rates in [0, MOST], those nearest to 1 in (two-sided) entropy that meet their source's token target are
exponential tilts by document size, r = MOST e^(lambda z) / (MOST - 1 + e^(lambda z)), z being the size over the
source's typical size. lambda is the optimum of the convex dual, one for each source. Newton iterations find it: each
sums gradient and curvature over the counts by (source, size), which hold no more than one row for each size that a
source has, and steps inside a bracket. The sums are exact, so that reruns agree to the last bit.

Copies: a document gets floor(r) copies, and one more if a uniform hash of it lies below r's fraction, moved by a
source-wide shift. The shift is the weighted quantile at which the copies' tokens meet the target, found to 24 bits
in two passes over histograms of 4,096 bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, cut, uniform, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 4096
#: Bytes up to which the table of sources is sent to all tasks.
BROADCAST = 8 << 20
STEPS, TOGETHER = 100, 5
TOLERANCE = 1e-9


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``sources`` (source, source_size) with each source's target; one row a source, of which there are few enough for one task."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.col("cap") * after <= F.col("weight") * (F.lit(share * total) - before))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.lit(share * total) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / open_weight).alias("target"))


def rate(size: Column) -> Column:
    """The tilted rate of a document of ``size`` words, from its source's ``target``, ``source_size``, ``scale`` and ``tilt``."""
    e = F.exp(-F.col("tilt") * size / F.col("scale"))
    return F.when(F.col("target") >= MOST * F.col("source_size"), F.lit(float(MOST))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.lit(float(MOST)) / (1 + (MOST - 1) * e))


def exact_sum(terms: Column, digits: int = 10) -> Column:
    """A sum of doubles below 10^18 (of whole ones below 10^28), each to ``digits`` decimals: the same in whatever order tasks end."""
    return F.sum(terms.cast(f"decimal(28, {digits})")).cast("double")


def _step(counts: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """``state`` after one Newton step, from one sum over ``counts``; nothing in it but this sum reads the state, so that steps chain."""
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    r = rate(size)
    held = F.broadcast(state) if small else state
    sums = counts.withColumnRenamed("source", "s").join(held, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
        exact_sum(n * size * r).alias("g"),
        exact_sum(n * size * size / F.col("scale") * r * (1 - r / MOST)).alias("h"),
        *(F.max(c).alias(c) for c in ("source_size", "target", "scale", "tilt", "low", "high")),
    )
    inf = float("inf")
    state = sums.withColumn("off", F.abs(F.col("g") - F.col("target")) / F.greatest("target", F.lit(1.0)))
    state = state.withColumn("low", F.when(F.col("g") < F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low")))
    state = state.withColumn("high", F.when(F.col("g") > F.col("target"), F.least("high", "tilt")).otherwise(F.col("high")))
    step = F.col("tilt") - (F.col("g") - F.col("target")) / F.greatest("h", F.lit(1e-300))
    wide = F.when(F.col("low") == -inf, 2 * F.col("tilt") - 1).when(F.col("high") == inf, 2 * F.col("tilt") + 1).otherwise((F.col("low") + F.col("high")) / 2)
    sound = (step > F.col("low")) & (step < F.col("high")) & (F.abs(step) <= 2 * F.abs(F.col("tilt")) + 4)
    tilt = F.when(F.col("off") <= TOLERANCE, F.col("tilt")).when(sound, step).otherwise(wide)
    return state.select("source", "source_size", "target", "scale", tilt.alias("tilt"), "low", "high", "off")


def solve(counts: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """``state`` (source, source_size, target) with scale and tilt, by Newton iterations over ``counts`` (source, size, n; size > 0).

    TOGETHER steps are one job; after each, the state is written. RuntimeError if ``STEPS`` steps don't meet the targets.
    """
    size, n, inf = F.col("size").cast("double"), F.col("n").cast("double"), float("inf")
    typical = counts.groupBy(F.col("source").alias("s")).agg((exact_sum(n * size * size, 0) / exact_sum(n * size, 0)).alias("scale"))
    state = state.join(typical, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    state = cut(state.select("source", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale")))
    now = state.select("*", F.lit(0.0).alias("tilt"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"))
    for _ in range(0, STEPS, TOGETHER):
        for _ in range(TOGETHER):
            now = _step(counts, now, small)
        now = cut(now)
        off = now.agg(F.max("off")).first()[0] or 0.0
        if off <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"after {STEPS} steps a source is still off its target by {off:.2g} of it")
    tilts = now.select(F.col("source").alias("s"), "tilt")
    both = state.join(F.broadcast(tilts) if small else tilts, F.col("source").eqNullSafe(F.col("s")), "left")  # sources without a word have none
    return cut(both.select("source", "source_size", "target", "scale", F.coalesce("tilt", F.lit(0.0)).alias("tilt")))


def _place(size: Column, draw: Column) -> Column:
    """Where a document's draw stands to the fraction of its rate, in 24 bits; null if it can't have one copy more."""
    r = rate(size)
    fraction = r - F.floor(r)
    return F.when((fraction > 0) & (size > 0), F.floor((draw - fraction + 1) / 2 * (BINS * BINS)).cast("long"))


def round_off(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """``state`` with each source's shift: documents of ``rows`` (source, size, draw) placed below it get one copy more."""
    at = rows.withColumnRenamed("source", "s").join(F.broadcast(state) if small else state, F.col("source").eqNullSafe(F.col("s")))
    at = at.select("source", "target", "size", F.floor(rate(F.col("size"))).alias("whole"), _place(F.col("size"), F.col("draw")).alias("place"))
    need = F.max("target") - F.sum(F.col("size") * F.col("whole"))
    needs = cut(at.groupBy(F.col("source").alias("s")).agg(need.alias("need")))

    def level(binned: DataFrame, left: DataFrame) -> DataFrame:
        """The first bin of each source at which the tokens below and in it reach what is left; null if all don't."""
        w = Window.partitionBy("source").orderBy("bin")
        sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("tokens"))
        sums = sums.withColumn("upto", F.sum("tokens").over(w)).join(left, F.col("source").eqNullSafe(F.col("s")))
        reach = sums.where(F.col("upto") >= F.col("need"))
        return reach.groupBy("s").agg(F.min(F.struct("bin", "tokens", "upto", "need")).alias("x")).select("s", "x.*")

    placed = at.where("place is not null")
    coarse = cut(level(placed.withColumn("bin", F.floor(F.col("place") / BINS)), needs).select("s", F.col("bin").alias("block"), (F.col("need") - F.col("upto") + F.col("tokens")).alias("need")))
    inside = placed.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("place") / BINS) == F.col("block")))
    fine = level(inside.select("source", "size", (F.col("place") % BINS).alias("bin")), coarse.select("s", "need"))
    # the bin that crosses is taken if that comes nearer to the target than leaving it
    fine = fine.select("s", (F.col("bin") + (F.col("upto") - F.col("need") < F.col("need") - F.col("upto") + F.col("tokens")).cast("long")).alias("bin"))
    shift = coarse.select("s", "block").join(fine.withColumnRenamed("s", "f"), F.col("s").eqNullSafe(F.col("f")), "left").select("s", (F.col("block") * BINS + F.coalesce("bin", F.lit(0))).alias("shift"))
    every = F.lit(4 * BINS * BINS).cast("long")
    return cut(state.join(shift, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("shift", F.coalesce("shift", every)))


def copies(size: Column, draw: Column) -> Column:
    """How often a document is taken, from its source's state."""
    return (F.floor(rate(size)) + F.coalesce((_place(size, draw) < F.col("shift")).cast("int"), F.lit(0))).cast("long")


def draw(doc_id: str = "doc_id", text: str = "text") -> Column:
    return uniform(F.col(doc_id), F.xxhash64(text))


def _small(sources: DataFrame) -> bool:
    """True if a table of a row per source may be sent to all tasks: its size is counted, and larger ones are joined by shuffle."""
    n, size = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return 128 * n + size <= BROADCAST


def balance(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, state): (doc_id, source, size, draw) of all documents, and the sources with target, tilt and shift, for broadcast if they are few."""
    rows = cut(docs.select("doc_id", "source", word_count("text").alias("size"), draw().alias("draw")))
    counts = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = cut(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    small = _small(sources)
    state = round_off(rows, solve(counts.where("size > 0"), sources, small), small)
    return rows, F.broadcast(state) if small else state


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, rate) of every row of ``docs`` (doc_id, text, source).

    size counts the words of the text (null: 0); taken is size times the copies that the mix takes, never more than
    MOST times size. Null is a source like any other, the last. Reruns agree: draws are hashes of doc_id and text, so
    identical rows are taken alike. Other columns are ignored; an empty table gives an empty result.
    """
    rows, state = balance(docs)
    mixed = rows.withColumnRenamed("source", "s").join(state, F.col("source").eqNullSafe(F.col("s")))
    taken = copies(F.col("size"), F.col("draw")) * F.col("size")
    return mixed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), rate(F.col("size")).alias("rate"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, 0 to MOST times; all columns are kept, whatever their names.

    A document without a word (null text) is taken once, or MOST times where its whole source is. A null source is one
    like any other, the last. Reruns agree, and identical rows are taken alike. An empty table gives an empty result.
    The texts aren't shuffled while the sources' table is small.
    """
    _, state = balance(docs)
    both = as_rows(docs).select("row", F.col("row.source").alias("s"), word_count(F.col("row.text")).alias("size"), draw("row.doc_id", "row.text").alias("draw"))
    both = both.join(state, F.col("s").eqNullSafe(F.col("source")))
    n = copies(F.col("size"), F.col("draw")).cast("int")
    return both.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")

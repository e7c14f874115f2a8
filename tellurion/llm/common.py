"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parallel import spread

#: Words, as all contracts of this subpackage take them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores where it comes in fewer parts than there are."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, in ``spark.checkpoint.dir``.

    Where that is unset, one is made under the master ``local`` (tests); on a cluster, whose machines don't share such a
    folder, ValueError.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder, so that nothing downstream runs its plan again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def as_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns in one struct, row: beside it, no name clashes with those that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: str | Column) -> Column:
    """Number of words of a text (null: 0), without materialising the words."""
    c = F.col(text) if isinstance(text, str) else text
    marks = F.regexp_replace(F.regexp_replace(c, r"[^\x20\x09-\x0D]++", "x"), r"[\x20\x09-\x0D]++", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def text_key(text: str | Column) -> Column:
    """Two independent 64-bit hashes of a text: a key that stands for the text in joins that must not carry it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(0x7E11), F.length(c), c).alias("b"))


def uniform(*cols: str | Column) -> Column:
    """A number in [0, 1) that depends on nothing but the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(0x51ED), *cols), 11).cast("double") / F.lit(float(1 << 53))


def learned_on(column: str, modulus: int, out: int) -> Column:
    """True for the rows that a contract lets a model learn from: crc32 of the id as text, modulo ``modulus``, isn't ``out``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus != out


_REMEMBERED: dict[tuple, object] = {}


def remembered(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, of one kind at a time: another key lets go of what was kept."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]

"""The package on the executors, where it isn't installed there."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def importable(master: str) -> bool:
    """True if Python workers find the package by themselves: by PYTHONPATH, or as they start in its folder.

    That can be told only of workers on the driver's own machine, under the master ``local``; executors elsewhere have
    folders and settings of their own.
    """
    if not re.fullmatch(r"local(\[.*\])?", master):
        return False
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == ROOT for p in places) or "site-packages" in ROOT.parts


def ship(spark: SparkSession) -> None:
    """Sends the package to the session's executors by Spark's own means, once, if they wouldn't find it."""
    sc = spark.sparkContext
    if importable(sc.master) or getattr(sc, "_tellurion_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "tellurion.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*sorted((ROOT / "tellurion").rglob("*.py")), ROOT / "corpus_pipeline.py"]:
            if f.exists():
                z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._tellurion_shipped = True

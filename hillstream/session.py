"""Session settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "hillstream", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as two underscores."""
    b = (SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package once per application, unless their Python path has its folder already."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_hillstream_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="hillstream-code-"), "hillstream.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.glob("hillstream/**/*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._hillstream_shipped = True

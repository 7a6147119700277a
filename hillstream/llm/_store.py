"""Intermediate tables in the folder that the cluster shares.

A table written there is read back by path, so a lost executor costs a re-read
and not a re-run of the plan that made the table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_dir.get() if set_dir.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = "file://" + tempfile.mkdtemp(prefix="hillstream-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scopes: list[list[Store]] = []


class Store:
    """Tables of one run of one operator, under a folder of their own, which goes when the application ends if not before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        if _scopes:
            _scopes[-1].append(self)

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that a later one has replaced, if it is there."""
        fs, path = self._at(self.path(name))
        fs.delete(path, True)

    def clear(self) -> None:
        fs, path = self._at(self.root)
        fs.delete(path, True)


@contextmanager
def cleared() -> Iterator[None]:
    """The tables of stores made inside go at the end; what is made from them has to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for store in _scopes.pop():
            store.clear()

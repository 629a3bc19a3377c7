"""Where operators cut their lineage: the folder that the session names."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders saved inside the scratch() blocks that are open, innermost last.
_SCRATCH: list[list[str]] = []


def ready(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir.  Where a session names none, a single JVM (as in tests) gets a folder of its own.

    A cluster without one raises: what one machine wrote to its own disk would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))


def saved(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    ready(df.sparkSession)
    out = df.checkpoint()
    if _SCRATCH:
        folder = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if folder.isDefined():
            _SCRATCH[-1].append(folder.get())
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end, so results must have been written before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.pop():
            remove(spark, folder)

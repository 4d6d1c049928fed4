"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where nothing is set, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are deleted at its end, but for those written with ``keep``.

    Whatever still reads them must have been written or collected by then. Without a scope tables stay, since a result may
    be read at any time.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Share of the driver's greatest heap that may be taken before what earlier steps have left is collected, and growth since then.
HEAP, GROWTH = 0.55, 1.2
_taken = 0.0


def give_back(spark: SparkSession, share: float = HEAP) -> bool:
    """Collect the driver's garbage if its heap has grown beyond ``share`` of what it may be, and by a fifth since the last time.

    Loops of many small jobs leave plans and compiled classes behind, of which a JVM frees the last only when it collects everything; its heap
    grows to its limit before it does.
    """
    global _taken
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    taken = runtime.totalMemory()
    if taken <= max(share * runtime.maxMemory(), GROWTH * _taken):
        return False
    gc.collect()
    spark._jvm.java.lang.System.gc()
    _taken = runtime.totalMemory()
    return True


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it again; ``keep``: beyond the :func:`scope` that is open, up to the one around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave-{name}-{uuid.uuid4().hex}"
    level = _scopes[: len(_scopes) - keep]
    if level:
        level[-1].append(path)
    give_back(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

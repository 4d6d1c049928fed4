"""Named tables in numbered versions: a reader sees a whole version or the one before, never half of one.

A version is a folder ``v<number>`` below a path. Whoever writes one takes the next number by creating its claim, writes the tables, and creates
an empty mark last. A version without a mark isn't there for readers, so that a job that is killed while it writes changes nothing. This relies on a file system that creates a
file either for one writer or for none, as HDFS and POSIX do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CLAIM, MARK = "_claim", "_whole"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(at, name)


def _numbers(spark: SparkSession, path: str) -> dict[int, bool]:
    """Every version's number, and whether it is whole."""
    fs, at = _files(spark, path)
    if not fs.exists(at(".")):
        return {}
    found = (re.fullmatch(r"v(\d+)", x.getPath().getName()) for x in fs.listStatus(at(".")))
    return {int(m[1]): fs.exists(at(f"{m[0]}/{MARK}")) for m in found if m}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions at ``path``, oldest first."""
    return sorted(n for n, whole in _numbers(spark, path).items() if whole)


def save(tables: dict[str, DataFrame], path: str) -> int:
    """Write ``tables`` as the next version and give its number; readers see it when all are written.

    The tables may be made from those of earlier versions, which stay as they are. Two writers get two numbers; the higher is the current one.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, at = _files(spark, path)
    number = max(_numbers(spark, path), default=0) + 1
    while not fs.createNewFile(at(f"v{number}/{CLAIM}")):
        number += 1
    for name, table in tables.items():
        table.write.parquet(f"{path}/v{number}/{name}")
    if not fs.createNewFile(at(f"v{number}/{MARK}")):
        raise RuntimeError(f"version {number} at {path} has been written by another")
    return number


def load(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest whole one if none is named."""
    whole = versions(spark, path)
    if version is None and whole:
        version = whole[-1]
    if version not in whole:
        raise FileNotFoundError(f"no version {version or ''} at {path}")
    fs, at = _files(spark, path)
    names = sorted(x.getPath().getName() for x in fs.listStatus(at(f"v{version}")) if x.isDirectory())
    return {name: spark.read.parquet(f"{path}/v{version}/{name}") for name in names}


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` newest whole versions, and what was begun before the oldest of these and never ended; gives the numbers that went.

    Readers of what goes fail, so keep as many as there may be read at a time. What is being written now has a higher number and stays.
    """
    if keep < 1:
        raise ValueError("at least the newest version stays")
    fs, at = _files(spark, path)
    kept = versions(spark, path)[-keep:]
    gone = sorted(n for n in _numbers(spark, path) if kept and n < kept[0])
    for n in gone:
        fs.delete(at(f"v{n}"), True)
    return gone

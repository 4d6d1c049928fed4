"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, scope  # noqa: F401  the operators cut their lineage with it

#: White space of every word and normalisation rule here, as the inside of a regular expression class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of maximal runs of characters other than white space (long)."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def is_held_out(column: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def label_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label double): one row per labelled doc_id; of contradicting labels the majority counts, a tie as 1."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("double").alias("label"))
    )


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of the id column, as a schema's text has it: operators pass ids on as they are."""
    return docs.schema[column].dataType.simpleString()


def bounded(df: DataFrame, key: Column, rows: int) -> list:
    """At most ``rows`` rows on the driver, a training sample: those of the smallest hashes of ``key``, equal ones by all columns.

    The share that fits is taken by hash where the rows are, and no task gives on more than ``rows``.
    """
    n, place = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if n > rows:
        # A few more than fit, so that a key of many rows, which fall to one side together, leaves the sample full.
        df = df.where(place < int(min(1.0, 1.1 * rows / n) * (1 << 40)))
    return df.orderBy(place, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).limit(rows).collect()

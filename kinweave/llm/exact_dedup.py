"""Exact dedup by distributed MSD radix partitioning.

A text is compared as a byte string led by its length in eight bytes, so that no string is the
beginning of another. All strings start in one group; each round splits every group by the next
digit, a run of successive bytes, with an aggregation and a join. A group of one row, or one whose
bytes are used up, is ready and leaves; only the others, without the bytes already compared, go on
to the next round. Digits widen from round to round, so that a text of n bytes takes O(log n)
rounds. Equal means equal bytes; no digest takes part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, text_of

#: Bytes of the first digit after the length, of the second, and how much wider each later one is.
FIRST, SECOND, WIDER = 24, 512, 16


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, rf"[{SPACE}]+", "")


def _best() -> Column:
    """The row of a group that stays: most code points, then smallest doc_id (null last), then a row's own number."""
    return F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), "row"))


def _deduped(docs: DataFrame, others: Column, keep_text: bool, first: int, second: int, wider: int) -> DataFrame:
    """(doc_id, text, others, keep_id, group_size, kept) of all rows of ``docs``."""
    norm = normalised(text_of()).cast("binary")

    def left(done: Column) -> Column:
        return F.col("text") if keep_text else F.when(~done, F.col("text")).alias("text")

    def split(rows: DataFrame, by: list[str], *best: Column) -> DataFrame:
        """``rows`` with n, and ``best``, of their group; null in a group of one row.

        Only groups of two rows or more are written, and the rows meet that table in a merge join of nothing but
        the two, which adaptive execution can split where a group is large, and which is the same at every size.
        """
        groups = rows.groupBy(*by).agg(F.count("*").alias("n"), *best).where("n > 1")
        return rows.join(materialise(groups, "groups").hint("merge"), by, "left")

    # Round 0: most texts differ in length or in their first bytes and leave here.
    rows = docs.select("doc_id", "text", others.alias("others")).withColumn("norm", norm)
    rows = rows.withColumn("grp", F.concat(F.lpad(F.hex(F.octet_length("norm")), 8, "0").cast("binary"), F.substring("norm", 1, first))).drop("norm")
    done = F.col("n").isNull()
    rows = split(rows, ["grp"]).select("doc_id", left(done), "others", "grp", done.alias("done"), F.length(text_of()).alias("points"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "radix")
    own = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    ready = [rows.where("done").select("doc_id", "text", "others", *own)]
    rows, start, width = rows.where("NOT done").drop("done"), first, second
    while not rows.isEmpty():
        rows = rows.withColumn("norm", norm).withColumns({"digit": F.substring("norm", start + 1, width), "ended": F.octet_length("norm") <= start + width}).drop("norm")
        done = F.col("ended") | F.col("n").isNull()  # a group's texts are of one length and end together
        rows = split(rows, ["grp", "digit"], _best().alias("best")).select("doc_id", left(done), "others", "points", "row", "n", "best", done.alias("done"), F.lpad(F.hex("best.row"), 16, "0").cast("binary").alias("grp"))
        rows = materialise(rows, "radix")
        ended = rows.where("done")
        ready.append(ended.where("n IS NULL").select("doc_id", "text", "others", *own))
        ready.append(ended.where("n > 1").select("doc_id", "text", "others", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept")))
        rows, start, width = rows.where("NOT done").drop("n", "best", "done"), start + width, width * wider
    return reduce(DataFrame.unionByName, ready)


def exact_dedup(docs: DataFrame, keep_text: bool = True, first: int = FIRST, second: int = SECOND, wider: int = WIDER) -> DataFrame:
    """All rows of ``docs`` (doc_id, text and any others) with keep_id, group_size and kept.

    Texts are equal when identical after deleting white space. Of equal texts the row with the most
    code points in its original text stays, then the smallest doc_id; keep_id is its doc_id.

    Null texts count as empty, and all empty or blank texts are one group. A null doc_id comes after
    all others. Of repeated rows (same doc_id and text) exactly one is kept. An empty table gives an
    empty result. Further columns are passed through, packed into one, so that their names clash
    with none used within; those named keep_id, group_size or kept are replaced. Without ``keep_text``
    the text comes back as null, which spares writing the texts of the groups that are ready.
    """
    found = ("keep_id", "group_size", "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text", *found)]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    out = _deduped(docs, packed, keep_text, first, second, wider)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[own.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns if c not in found], *found)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns as they are, with one row of each group of equal texts (see :func:`exact_dedup`)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    out = _deduped(docs, packed, True, FIRST, SECOND, WIDER).where("kept")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[own.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])

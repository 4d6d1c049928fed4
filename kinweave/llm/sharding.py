"""Sharding by a two-pass external shuffle.

The first pass scatters the records uniformly into buckets that fit into memory, by a seeded hash of
each record. The second pass shuffles each bucket on its own by Fisher-Yates with a generator seeded
by the bucket. The buckets one after another are then a random permutation of all records; its
positions are dealt to the shards in turn, so that any two shards differ by one record at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import materialise, text_of

#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 16 << 20
SEED = 20
#: Copies of a row that one task numbers; buckets whose counts are summed up together.
COPIES, SET = 65536, 4096


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the record's frame (long)."""
    return F.octet_length(text_of(text)).cast("long") + 8


def _fisher_yates(seed: int):
    def shuffled(table: pa.Table) -> pa.Table:
        order = np.argsort(table["mark"].to_numpy(), kind="stable")
        rng = np.random.default_rng([seed, table["bucket"][0].as_py()])
        rng.shuffle(order)  # numpy's shuffle is Fisher and Yates'
        place = pa.array(np.arange(len(order)) + table["offset"][0].as_py(), pa.int64())
        return table.select(["record"]).take(pa.array(order)).append_column("place", place)

    return shuffled


def _holds_map(kind: DataType) -> bool:
    """Whether a map stands anywhere in a type; such a column can't be hashed as it is."""
    if isinstance(kind, MapType):
        return True
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _marked(docs: DataFrame, seed: int) -> DataFrame:
    """(record, mark): every row packed into one column, with a seeded hash of all its columns that parts repeated rows too.

    Rows whose hash is not theirs alone are folded, which sums up where the rows are, and numbered; their number goes into the
    hash, so that copies of one row scatter like any others, be they two or a third of all rows. What was folded is unfolded
    in two steps, so that no task emits more than :data:`COPIES` rows for one it has read.
    """
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema]
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(packed.alias("record"), F.xxhash64(F.lit(seed), *hashed).alias("mark"))
    often = materialise(rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "repeated")
    if often.isEmpty():
        return rows
    hot = rows.join(often, "mark", "left_semi").groupBy("record", "mark").agg(F.count("*").alias("n"))
    hot = hot.withColumn("set", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int")))).repartition("mark", "set")
    within = F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("n") - F.col("set").cast("long") * COPIES).cast("int"))
    hot = hot.withColumn("k", F.explode(within)).select("record", F.xxhash64("mark", "set", "k").alias("mark"))
    return rows.join(often, "mark", "left_anti").select("record", "mark").union(hot)


def external_shuffle(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` (doc_id, text and any others) with shard (int) and slot (long, gapless from 0 in each shard).

    The law is ``rows``: the shards' row counts are at most one apart. The same rows, seed and
    bucket size give the same shards again, however the input is partitioned; rows equal in all columns
    are interchangeable. Null texts count as empty bytes, null doc_ids are hashed by the other
    columns. Repeated rows, few or many, are dealt to all buckets, so that a bucket is as large as chance and its
    longest text make it. An empty table gives an empty result; further columns are passed through, packed into one; those named
    shard or slot are replaced.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(record_size())).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = _marked(docs, seed).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), F.lit(buckets)))
    # Offsets of buckets by prefix sums in two levels: of sets of buckets, and within each of them.
    counts = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("set", F.floor(F.col("bucket") / SET)), "buckets")
    sets = counts.groupBy("set").agg(F.sum("n").alias("m")).select("set", (F.sum("m").over(Window.orderBy("set")) - F.col("m")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("set").orderBy("bucket")) - F.col("n")
    offsets = counts.withColumn("within", within).join(sets, "set").select("bucket", (F.col("before") + F.col("within")).alias("offset"))
    rows = rows.join(offsets, "bucket")
    shuffled = rows.groupBy("bucket").applyInArrow(_fisher_yates(seed), rows.select("record").schema.add("place", "long"))
    at = F.col("place")
    return shuffled.select(*[F.col("record").getField(c).alias(c) for c in kept], (at % shards).cast("int").alias("shard"), F.floor(at / shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs`` as Parquet below ``path``, a folder for each shard, its rows in order of their slots within each file."""
    out = external_shuffle(docs, shards, seed, bucket_bytes)
    out.repartition(shards * 4, "shard", F.floor(F.col("slot") / (1 << 20))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

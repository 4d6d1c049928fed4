"""Registers that arrive file by file: each micro-batch is ingested as a whole, and a file that comes again replaces its entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.ingest import to_entries, to_fields


def stream_entries(spark: SparkSession, source: str, schema: StructType, mapping: list, register: str, target: str, checkpoint: str, blanks: tuple = ()) -> StreamingQuery:
    """Start a query that ingests the CSV files of a folder (each a sheet with headings) into Parquet below ``target``, a partition for each file.

    Batches overwrite the partitions of their files only, so that a batch that is run again changes nothing. Rows are numbered by
    their content, since a file's rows come in no order.
    """
    rows = spark.readStream.schema(schema).option("header", True).csv(source).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))

    def ingest(batch: DataFrame, _: int) -> None:
        keyed = batch.withColumn("entry", F.sha2(F.to_json(F.struct(*batch.columns)), 256))
        entries = to_entries(to_fields(keyed, mapping, list(blanks)), register).join(keyed.select("entry", "file").distinct(), "entry")
        entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(target)

    return rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The corpus pipeline: from raw documents to the pieces of a training mix.

Each stage takes all that the one before it kept, as Parquet, and returns the columns of documents;
the last one returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import materialise, scope
from kinweave.llm.exact_dedup import keep_first
from kinweave.llm.mixing import mixed
from kinweave.llm.near_dedup import keep_one
from kinweave.llm.pieces import Vocabulary, recode
from kinweave.llm.quality import keep_good
from kinweave.llm.queries import PIECE_MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: each document as often as its source's share of 150 % of all words has it, none to two times."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_ids, round_trip): each document's pieces, and whether they decode to its very text."""
    vocabulary = Vocabulary.load(PIECE_MODEL)
    coded = recode(docs.select("doc_id", "source", "text"), vocabulary)
    return coded.select("doc_id", "source", "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("pieces", pieces)]

#: SQL has no expression for learnt models, MinHash and pieces; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written and read again; what a stage has written for itself goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anomalies import judge
from .common import materialise, text_of
from .exact_dedup import exact_dedup, normalised
from .hard_negatives import mine_hard_negatives, quantised
from .licences import scan_licences
from .mixing import measured, mix_measured
from .near_dedup import jaccard_classes
from .pieces import Vocabulary, recode
from .pii import find_pii
from .quality import score_quality
from .ranked_search import search
from .secrets import scan_secrets
from .sharding import external_shuffle, record_size
from .url_filter import filter_urls

#: A model of a public tokenizer; override with the environment's own path.
PIECE_MODEL = os.environ.get("KINWEAVE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normalised(text_of()).cast("binary"), 256).alias("text_sha256"))
    return exact_dedup(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by the rule ensemble."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether they decode to the very text."""
    vocabulary = Vocabulary.load(PIECE_MODEL)
    coded = recode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == text_of()).alias("round_trip"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in one of 24 shards of an external shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs, 24).select(
        "doc_id", record_size().alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of a secret in every document, and whether the forest takes it for one."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule statistics and the verdict of the base rules and the isolation forest."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with the rule that decides on it, else its host's reputation."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of 150 % of all words takes from it."""
    out = mix_measured(materialise(measured(table(spark, sf_dir, "documents"), pack=False), "measured"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "n_links")


def op10_licence_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and the licences whose templates match."""
    return scan_licences(table(spark, sf_dir, "documents"))


def op11_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: the base patterns' spans, and those that the tagger adds."""
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's ten best documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor, a hundredth of the vectors, for each of its positives."""
    # A seventh of the labels is wrong on purpose, so that near rows of another label exist.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector"))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_quality_rules, op3_piece_codec, op4_sharding, op5_secret_forest, op6_isolation_forest, op7_url_reputation, op8_mixing, op9_jaccard_join, op10_licence_templates, op11_pii_tagger,
        op12_ranked_search, op13_hard_negatives,
    )
}

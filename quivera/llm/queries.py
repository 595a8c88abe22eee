"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, line_dedup, media, mixing, pieces, quality_rules, rule_ensemble, sharding, simhash, toxicity
from .common import write_table
from .oracles import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip: every whole text encoded, and its ids decoded and compared."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, keep=["doc_id"], round_trip="round_trip")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = rule_ensemble.train(docs, _table(spark, sf_dir, "labels"))
    scored = rule_ensemble.classify(docs, model, keep=["doc_id"], threshold=0.3)
    return scored.select("doc_id", (rule_ensemble.fold() == 0).alias("held_out"), "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text, n_chars: the rendering of every whole page."""
    made = html_text.extract_text(_table(spark, sf_dir, "pages"), keep=["page_id"])
    return made.select("page_id", "text", F.length("text").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measured = write_table(quality_rules.measure(docs, keep=["doc_id", "lang", "source"]), "quality-measures")
    sketch = write_table(quality_rules.sketches(measured), "quality-sketches")
    limits = write_table(quality_rules.thresholds(sketch), "quality-limits")
    judged = quality_rules.judge(measured, limits)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without lines of recurring templates, and how many were dropped."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs, count_into="n_dropped")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs, model, keep=["doc_id"], threshold=0.5)
    return scored.select("doc_id", (rule_ensemble.fold() == 0).alias("held_out"), "score", "predicted")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the image's size from header-only reads and the member's place."""
    rows, store = media.store_media(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return media.describe(rows, store).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = write_table(mixing.sized(_table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = write_table(sharding.keyed(_table(spark, sf_dir, "documents")), "shard-keys")
    return sharding.shard(keys).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_media_columns": op8_media_columns,
    "op9_source_mixing": op9_source_mixing,
    "op10_histogram_sharding": op10_histogram_sharding,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

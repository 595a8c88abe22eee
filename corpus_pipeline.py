"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents`` (the last one adds token columns). ``run`` writes each stage as Parquet in the shared folder and
reads it again for the next; what a stage wrote for itself, and its input, are deleted when its result is written.

Defined results, of every stage: a null or empty text fails the quality rules, and an empty one that line dedup leaves is
a document like any other, of which near-dedup keeps one; very long texts are worked on whole; of rows repeated, and of groups of
near copies, the row of the smallest id stays; null languages and sources are groups of their own; an empty table stays
empty; columns beyond those of ``documents`` are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quivera.llm import line_dedup, mixing, pieces, quality_rules, simhash
from quivera.llm.common import delete_tables, write_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the base rules and the fences of their language and source."""
    measured = quality_rules.measure(docs, keep=["lang", "source"])
    limits = write_table(quality_rules.thresholds(write_table(quality_rules.sketches(measured), "pipeline-sketches")), "pipeline-limits")
    # Measured again with the texts at hand: cheaper than a written copy of the texts, and safe for any doc_id.
    return quality_rules.judge(quality_rules.measure(docs, keep=COLUMNS), limits).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of recurring templates; n_chars follows the text."""
    return line_dedup.drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding them gave the text back."""
    return pieces.encode(docs, round_trip="round_trip")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Encoding and near-duplicate components are beyond SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(written)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete_tables(spark, written[others:-1])
    return STAGES[-1][1](spark, docs, sf_dir)

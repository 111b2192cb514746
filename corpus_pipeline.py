"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before it kept and returns a DataFrame;
between stages the rows are written as Parquet and read again, so a lost
executor costs no earlier stage. What a stage staged on its way is deleted when
its rows are written. An empty table passes through all stages as one; columns
beyond those of documents pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import exact_dedup, near_dedup, packing, pii, quality
from kindred.llm.store import clearing, discard, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts are judged as empty ones, repeated rows alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest key; null texts are empty ones, of repeated rows one stays."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest key; texts without words all stay."""
    return near_dedup.drop_near(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; n_chars follows the text. Null texts stay null, every row stays."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row per piece of a document, with its ids, their checksum and its place. Null and empty texts are the end id alone."""
    return packing.pack_documents(docs, payload=("ids", "ids_crc32"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with clearing() as kept:
            docs = staged(stage(spark, before, sf_dir), name)
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no classifier and no tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None

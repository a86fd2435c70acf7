"""From raw documents to token files: quality, near-duplicates, contamination, mixture, tokens.

Each stage takes all that its predecessor kept, written as Parquet and read
again, and its decisions take effect. All but the last return the columns of ``documents``.

Defined cases: null and empty texts are scored, have no duplicates, hold no item and are never
taken into the mixture; rows without an id are kept or dropped each by its own text; of an id with several texts the
near-duplicate and contamination stages decide all rows alike; repeated rows go one way; empty tables go through
all stages as empty tables; columns of other names, and clashing ones, are carried along unread.

In stages on word shingles, near-duplicates share five-word shingles to 80 %.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograde.llm import decontamination, mixing, near_dedup, quality, token_files
from velograde.llm.workdir import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of those that are there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return quality.accepted(docs, labels)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return near_dedup.distinct_documents(docs, size=SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of training."""
    return mixing.passes(docs).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all passes in the order of training, which is that of the rows in the mixture's files; read back, one row per record."""
    import public_tokenizers

    return token_files.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), as_stored=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: SQL has no counterpart of the trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

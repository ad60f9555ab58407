"""From raw documents to token digests in five stages, each written and read again.

Stages: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontam, line_dedup, near_copies, quality
from colloquy.llm.bpe import bpe_round_trip, digests
from colloquy.llm.common import discard, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go after their first occurrence, and with them documents that had nothing else."""
    cut = line_dedup.cut_lines(docs).where("n_lines = 0 or n_lines > n_removed")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("left"), "n_chars": F.when(changed, F.length("left").cast("long")).otherwise(F.col("r.n_chars"))}
    return cut.select(*[new.get(c, F.col("r")[c]).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group stays: five-word shingles, similarity 0.8, every pair; SimHash tiles first."""
    return near_copies.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return digests(bpe_round_trip(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: The classifier is fitted and byte-pair merges are searched, which SQL can't express; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        left = stage(spark, docs, sf_dir)
        docs = materialise(left, name.replace(" ", "-"))
        discard(left)  # what the stage had written, and the output of the stage before
    return STAGES[-1][1](spark, docs, sf_dir)

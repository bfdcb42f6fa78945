"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Quality classifier (rejected documents go), n-gram Jaccard join (one document of each group stays),
benchmark decontamination, mixing of sources to target weights (a document stays as often as the mix
takes it), token files.  Every stage takes all that its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import blocks, crf, decontaminate, jaccard, mixing, token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_output(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", tokens),
]

#: Training, random rounding and tokenizing are not SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = blocks.materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs

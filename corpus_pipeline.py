"""A training corpus from the table documents: language, boilerplate, near-copies, benchmarks, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm import decontaminate, jaccard, langid, line_dedup, packing
from lexgraph.llm.common import written
from lexgraph.session import ship, spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not rejected: those with letters, not far from every language learned."""
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs, model, keep=tuple(docs.columns)).where("NOT rejected").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines of each source; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-copies."""
    ship(spark)
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; a row per piece."""
    ship(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Neither the fitted centroids nor the tokenizer can be stated in SQL; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sinks: JSON lines, graphs, indexes, terms, submissions, and one that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import exists


def json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; other scripts than Latin stay as they are."""
    df.write.mode("overwrite").json(path)


def concat_lines(spark, sources: list[str], path: str) -> None:
    """The lines of the sources that exist, blank ones left out."""
    found = [p for p in sources if exists(spark, p)]
    lines = spark.read.text(found) if found else spark.createDataFrame([], "value string")
    lines.where(F.trim("value") != "").write.mode("overwrite").text(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables as Parquet below path."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def trees(nodes: DataFrame, path: str, key: str = "law", **options) -> None:
    """Trees of nodes as JSON lines, {key, tree}, each node with its children inside it."""
    from ..operators.trees import nested

    found = nested(nodes, key, **options)
    head = F.to_json(F.struct(key))
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"tree":'), F.col("tree"), F.lit("}"))
    found.select(line.alias("value")).write.mode("overwrite").text(path)


def vector_index(chunks: DataFrame, path: str, model: str, size: int, overlap: int, bm25=None) -> DataFrame:
    """Chunks with embeddings, and the lexical index if given; returns the manifest, one row, which is written too."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    if bm25 is not None:
        bm25.write(f"{path}/bm25")
    rows = chunks.sparkSession.read.parquet(f"{path}/chunks")
    manifest = rows.agg(F.lit(model).alias("embedding_model"), F.max(F.size("embedding")).alias("embed_dim"), F.lit(size).alias("chunk_chars"), F.lit(overlap).alias("chunk_overlap"), F.count("*").alias("count"), F.lit(bm25 is not None).alias("bm25"), F.lit(2).alias("schema_version"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def build_once(spark, path: str, build) -> DataFrame:
    """What is written at path, made by build() if nothing is there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def terms(rows: DataFrame, path: str) -> None:
    """Terms and definitions as CSV, JSON lines and lines of text."""
    rows.select("term", "definition").write.mode("overwrite").csv(f"{path}/csv", header=True, quoteAll=True, escape='"')
    rows.select("term", "definition").write.mode("overwrite").json(f"{path}/jsonl")
    rows.select(F.concat("term", F.lit(" / "), "definition").alias("value")).write.mode("overwrite").text(f"{path}/txt")


def submission(rows: DataFrame, path: str) -> None:
    rows.select("ID", "Answer").write.mode("overwrite").csv(path, header=True, escape='"')


def token_lines(rows: DataFrame, tokens: Column, path: str, n: int = 40) -> None:
    """Lines of n tokens each."""
    from ..functions.vectors import grouped

    rows.select(F.explode(grouped(tokens, n)).alias("value")).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key is not written yet, each key once; returns how many there were."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    before = 0
    if exists(spark, path):
        done = spark.read.schema(rows.schema).parquet(path).select(key)
        before = done.count()
        new = new.join(done, key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count() - before

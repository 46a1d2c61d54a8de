"""Streams in place of loops with checkpoints: files that arrive to chunks, rows once by key, questions to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25
from ..operators.corpus import text_chunks
from ..sources.writers import append_new


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of whole text files as they arrive."""
    return spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.txt").text(folder).select(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, size: int = 900, overlap: int = 200, **trigger) -> StreamingQuery:
    """Chunk arriving files and append the chunks to out, each id once, however often a batch is run again."""

    def save(batch: DataFrame, _: int) -> None:
        append_new(text_chunks(batch, "file", "text", size, overlap), out)

    trigger = trigger or {"availableNow": True}
    return watch(spark, folder).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def once_by_key(rows: DataFrame, out: str, checkpoint: str, key: str = "id", **trigger) -> StreamingQuery:
    """Append a stream's rows to the Parquet folder out, the first of each key only.

    The keys seen are a streaming state, dealt by key and kept in the checkpoint: nothing that was written is read
    again, and a batch that is run anew after a fault writes what it wrote before. A null key is a key. The output is
    read with spark.read.parquet(out), which goes by the sink's log.
    """
    trigger = trigger or {"availableNow": True}
    return rows.dropDuplicates([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def answered(spark: SparkSession, folder: str, index: str, out: str, checkpoint: str, k: int = 5, **trigger) -> StreamingQuery:
    """Questions that arrive as JSON lines (query_id, query) in folder, joined with the lexical index written at index.

    The k best documents of each question (query_id, doc_id, score, rank) are written below out in a folder per batch; a
    batch that is run anew replaces its folder, so that each file of questions is answered once.
    """

    def save(batch: DataFrame, number: int) -> None:
        found = bm25.Index.read(spark, index)
        bm25.top(bm25.positive(found, bm25.query_terms(batch), most=k), k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    trigger = trigger or {"availableNow": True}
    asked = spark.readStream.schema("query_id long, query string").json(folder)
    return asked.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()

"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark, "_lexgraph_dir"):
        spark._lexgraph_dir = "file://" + tempfile.mkdtemp(prefix="lexgraph-")
    return spark._lexgraph_dir


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it goes when the session ends."""
    path = f"{shared_dir(spark)}/lexgraph-{uuid.uuid4().hex}-{name}"
    at, system = _file_system(spark, path)
    system.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and its rows outlive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexgraph_path = path
    return out


def stored(path: str, rows: int = 1):
    """The Arrow batches of a written table, read in a task, `rows` rows at a time; the folder must be on a file system that pyarrow knows."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path)
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            yield from pq.ParquetFile(system.open_input_file(info.path)).iter_batches(batch_size=rows)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    at, system = _file_system(df.sparkSession, df._lexgraph_path)
    system.delete(at, True)

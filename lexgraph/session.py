"""SparkSession settings that the library expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold for every run; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """Return a session with SETTINGS, made anew unless one runs already."""
    builder = SparkSession.builder.appName("lexgraph").config(map={**SETTINGS, **more})
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Bytes up to which a table that comes in few partitions is dealt to all cores.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is small and comes in fewer partitions: a file of one row group is one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(n) if int(str(size)) <= SMALL and df.rdd.getNumPartitions() < n else df


#: Rows of an Arrow batch, where the session's settings state none: whole documents are long, and both sides of a
#: pipe keep buffers of the size of its largest batch.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session (they need not have it on their path), in moderate batches."""
    context = spark.sparkContext
    if not context.getConf().contains(ARROW_ROWS[0]):
        spark.conf.set(*ARROW_ROWS)
    if getattr(context, "_lexgraph_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lexgraph-")) / "lexgraph.zip"
    atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(to))
    context._lexgraph_shipped = True

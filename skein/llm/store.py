"""Tables between the phases of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only where that is unset (tests, a single machine) a folder of our own is made and set.
    """
    for conf in (spark.sparkContext.getConf().get, lambda k: spark.conf.get(k, None)):
        if found := conf("spark.checkpoint.dir"):
            return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        own = tempfile.TemporaryDirectory(prefix="skein-")
        atexit.register(own.cleanup)
        _LOCAL[app] = f"file://{own.name}"
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


#: Each row a row group of its own.  Else a task buffers at least 100 rows before it writes any, keeps the least and
#: greatest value of each row group, and readers decode up to 4096 rows at once, of whatever size.
LARGE_ROWS = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false"}


def materialise(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the re-reading of files, not the phases before.  The
    files stay until the application ends (``release``), as a caller may read its result twice.
    ``large_rows`` says that rows are of megabytes, so that a task holds one of them at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything ``materialise`` has written for this application."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def given_back(run):
    """``run`` for mapInArrow, whose task leaves the worker's free memory to the system, as workers outlive tasks."""

    def wrapped(batches):
        yield from run(batches)
        del batches
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound what one Arrow batch of whole texts holds, unless the session already says so."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))

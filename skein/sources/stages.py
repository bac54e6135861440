"""Tables between the rounds of an iterative plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; an own folder only where that is unset (tests, one machine)."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.TemporaryDirectory(prefix="skein-rounds-")
        atexit.register(folder.cleanup)
        _OWN[app] = f"file://{folder.name}"
    return _OWN[app]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as written Parquet: its lineage ends here, so a lost executor repeats one round at most."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = 500, mb: int = 4) -> None:
    """Bound what one Arrow batch of whole texts holds, unless the session already says so."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))

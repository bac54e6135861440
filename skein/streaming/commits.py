"""Streams that are written in groups of pages, once each, and onsets met with the events they may belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def committing(pages: DataFrame, target: str, order: list[str], *, every: int = 5) -> DataStreamWriter:
    """A writer that commits a stream's pages in groups of ``every``, in ``order`` within a micro-batch; the rest is a group too."""
    return pages.writeStream.foreachBatch(lambda batch, number: commit_batch(batch, number, target, order, every=every))


def commit_batch(batch: DataFrame, number: int, target: str, order: list[str], *, every: int = 5) -> None:
    """Write a micro-batch as one folder of ``target``, then its entry of the ledger.

    A batch that is run again, as after a lost driver, writes the same folder anew; one that
    the ledger has is left alone.  So pages count once, and readers (``committed``) see whole batches only.
    """
    spark = batch.sparkSession
    if _ledger(spark, target).filter(F.col("batch") == number).count():
        return
    # one number for each page of the batch: ranges of the order, then places in them
    ranged = batch.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    path = f"{target}/pages/batch={number}"
    ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order))).write.mode("overwrite").parquet(path)
    parts = spark.read.schema("__p int").parquet(path).groupBy("__p").agg(F.count("*").alias("pages"))
    before = F.coalesce(F.sum("pages").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ledger = parts.select(F.lit(number).cast("long").alias("batch"), F.col("__p").alias("part"), before.alias("before"), "pages", F.lit(every).alias("every"))
    ledger.coalesce(1).write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")


_LEDGER = "batch bigint, part int, before bigint, pages bigint, every int"


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The folders ``batch=n`` of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []


def _ledger(spark: SparkSession, target: str) -> DataFrame:
    """Entries that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f for f in _files(spark, f"{target}/ledger") if fs.exists(path(f"{f}/_SUCCESS"))]
    return spark.read.schema(_LEDGER).parquet(*done) if done else spark.createDataFrame([], _LEDGER)


def committed(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The pages that the ledger vouches for (``schema`` is theirs), with their batch and ``commit``, the group in it, from 0."""
    ledger = _ledger(spark, target)
    numbers = [r[0] for r in ledger.select("batch").distinct().collect()]
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch bigint, commit bigint")
    own = spark.read.schema(f"{schema}, __p int, __i int, batch bigint").option("basePath", f"{target}/pages").parquet(*[f"{target}/pages/batch={n}" for n in numbers])
    met = own.join(ledger.select("batch", F.col("part").alias("__p"), "before", "every"), ["batch", "__p"])
    return met.withColumn("commit", F.floor((F.col("before") + F.col("__i") - 1) / F.col("every"))).drop("__p", "__i", "before", "every")


def onsets_of_events(onsets: DataFrame, events: DataFrame, *, key: str, onset_at: str, armed_at: str, early: str = "30 milliseconds", late: str = "3 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Pairs of an onset and an armed event of its key: the onset from ``early`` before arming until ``late`` after it.

    For tables and for streams alike.  Both streams may lag and be out of order by ``watermark``; beyond it
    rows are late and dropped.  State is bounded: an onset is kept until no event that may still come can
    reach back to it, an event until no onset can.  All columns of both sides, ``key`` once; other names must differ.
    Null keys and times pair with nothing.
    """
    o = onsets.withWatermark(onset_at, watermark).withColumnRenamed(key, "__key")
    e = events.withWatermark(armed_at, watermark)
    near = (F.col("__key") == F.col(key)) & (F.col(onset_at) >= F.col(armed_at) - F.expr(f"INTERVAL {early}")) & (F.col(onset_at) <= F.col(armed_at) + F.expr(f"INTERVAL {late}"))
    return o.join(e, near).drop("__key")

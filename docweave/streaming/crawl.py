"""Streams over append-only logs, run on what has arrived so far and written to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; one of our own only where that is unset on a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docweave-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming plan over all that is there and return what it wrote."""
    spark = stream.sparkSession
    at = shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def read_log(spark: SparkSession, path: str, time: str) -> DataFrame:
    """A Parquet table as a stream, with ``time`` as an event time that watermarks can use."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema)
    # A table may be one file or a folder of files.
    stream = source.option("pathGlobFilter", name).parquet(folder) if path_is_file(spark, path) else source.parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def path_is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def first_of_each(log: DataFrame, key: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each row once, as long as its copies come within ``late`` of each other."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_windows(log: DataFrame, time: str) -> DataFrame:
    """Requests of each day, for a stream with a watermark; a day is written when the watermark has passed it."""
    return (
        log.groupBy(F.window(time, "1 day").alias("w"))
        .agg(F.count("*").alias("total_requests"), F.sum(F.col("success").cast("long")).alias("successful"), F.sum(F.col("used_cache").cast("long")).alias("from_cache"))
        .select(F.to_date("w.start").alias("crawl_date"), "total_requests", "successful", "from_cache")
    )

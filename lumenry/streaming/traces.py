"""The call log as a stream: de-duplication within a watermark and daily usage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.sources.shared import shared_dir


def deduplicated(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Calls by event time, each id once among those that arrive within the delay. State is bounded by the watermark."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_usage(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """(event_type, day, n, tokens) of the log at ``path``, read as a stream until its present end.

    The de-duplicated calls go to a table in the shared folder, with checkpoints, so a restart goes on where it was."""
    base = shared_dir(spark)
    run = f"{base.rstrip('/')}/trace-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a log is a folder of files; the stream's source takes this one by its name
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-1]}?")
    calls = source.withColumn("ts", F.col("ts").cast("timestamp"))
    done = deduplicated(calls, delay).writeStream.format("parquet").option("path", f"{run}/calls").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = spark.read.parquet(f"{run}/calls")
    return rows.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum(k).alias("tokens"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()

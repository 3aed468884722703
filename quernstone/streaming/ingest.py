"""Documents and events as streams: append-only records, first-seen dedup, windows, checkpoints by batch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_folder(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen; with an event time the state of keys past the watermark is dropped."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, by: str, width: str, delay: str) -> DataFrame:
    """(start, end, by, n, total): tumbling windows, late rows dropped past the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    w = timed.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("window.start", "window.end", by, "n", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str, delay: str) -> DataFrame:
    """(start, end, by, n): runs of events with pauses under ``gap``."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    w = timed.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return w.select("session_window.start", "session_window.end", by, "n")


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into a Parquet table; started again with the same checkpoint it goes on where it stopped."""
    query: StreamingQuery = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def latest_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """A stream's aggregate as it stands when what is there is drained: every batch writes the whole table to a folder of its own, and the last one counts.

    Tasks write it, so nothing of it passes through the driver, and a batch that runs twice replaces itself. A stream without a batch gives an empty table.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:010d}")

    stream.writeStream.foreachBatch(one).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark, schema = stream.sparkSession, T.StructType([*stream.schema.fields, T.StructField("batch", T.StringType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    whole = spark.read.schema(schema).parquet(folder)
    return whole.where(F.col("batch") == whole.agg(F.max("batch")).first()[0]).drop("batch")


def fingerprint(config: dict) -> str:
    """The digest of a configuration in canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class ConfigChanged(ValueError):
    """A checkpoint that was made under another configuration."""


def process_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, config: dict) -> DataFrame:
    """Each micro-batch through ``work`` into a folder of its own, so a batch that runs twice replaces itself.

    The configuration's fingerprint is kept with the results; going on under another one is refused.
    """
    spark, mark = stream.sparkSession, fingerprint(config)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_config")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        kept = spark.read.text(f"{folder}/_config").first()[0]
        if kept != mark:
            raise ConfigChanged(f"results are of configuration {kept[:12]}, not {mark[:12]}")
    else:
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{folder}/_config")

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).drop("batch")

"""Documents as a file stream to an append-only audit log, and counts over that log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docguard.session import is_directory


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a stream, be it a folder of files or a single file."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_directory(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def each_once(docs: DataFrame, at: str, late: str = "1 day", key: str = "sample_id", text: str = "text") -> DataFrame:
    """Each document of a stream once, however many files it arrives in within the delay; the first one stays.

    `at` is the time of a document; keys are forgotten when the watermark passes it by `late`.  Rows without a key are the
    same if their texts are.
    """
    named = F.coalesce(F.concat(F.lit("key:"), F.col(key).cast("string")), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return docs.withColumn("_once", named).withWatermark(at, late).dropDuplicatesWithinWatermark(["_once"]).drop("_once")


def stream_decisions(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                     file_format: str = "parquet") -> StreamingQuery:
    """Decide every new document once and append it to the audit log; stops when all is read.

    The plan has no state, and the checkpoint with the file sink makes each append exactly once.
    """
    writer = decide(docs).writeStream.format(file_format).outputMode("append")
    if file_format == "json":
        writer = writer.option("ignoreNullFields", False)
    return writer.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counts_by_window(audit: DataFrame, key: str = "decision", window: str = "1 hour",
                              late: str = "10 minutes") -> DataFrame:
    """Counts per time window and key over an audit stream; rows later than the watermark are dropped."""
    timed = audit.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return timed.groupBy(F.window("timestamp", window), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n")


def stream_decision_counts(audit: DataFrame, sink: str, checkpoint: str, key: str = "decision",
                           window: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Write the closed windows of decision_counts_by_window; stops when all is read."""
    counts = decision_counts_by_window(audit, key, window, late)
    return counts.writeStream.format("parquet").outputMode("append").option("path", sink) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

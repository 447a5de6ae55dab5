"""Segments as a stream: once each despite re-delivery, merged into sessions, corrected batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "row_id bigint, file_id string, seq int, `start` double, `end` double, text string, speaker string, confidence double, received_at timestamp"


def read(spark: SparkSession, path: str, files_at_once: int = 10) -> DataFrame:
    """Parquet files of segments as they arrive; ``files_at_once`` bounds a batch."""
    return spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each (file, seq) once; state is dropped when a re-delivery would be later than ``late``."""
    return stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["file_id", "seq"])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of arrivals per file with their number of segments; works on streams and tables alike."""
    marked = stream.withWatermark("received_at", late) if stream.isStreaming else stream
    out = marked.groupBy("file_id", F.session_window("received_at", gap).alias("w")).agg(F.count("*").alias("segments"))
    return out.select("file_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "segments")


def windows(stream: DataFrame, length: str = "60 minutes", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding windows over arrivals with their number of segments."""
    marked = stream.withWatermark("received_at", late) if stream.isStreaming else stream
    out = marked.groupBy(F.window("received_at", length, slide).alias("w")).agg(F.count("*").alias("segments"))
    return out.select(F.col("w.start").alias("window_start"), "segments")


def corrected(stream: DataFrame, rules_path: str, correct: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str):
    """Each batch is corrected with the rules as they stand when it begins; new rules take effect from the next batch on."""

    def batch(df: DataFrame, number: int) -> None:
        rules = df.sparkSession.read.parquet(rules_path)
        correct(df, rules).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

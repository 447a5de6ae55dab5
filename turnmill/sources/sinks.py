"""Reports: an append-only history and the latest one beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, run_id: str) -> None:
    """Appends the report under its run and replaces ``latest``."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(f"{path}/history")
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{path}/latest")


def history(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """Runs by the time their files changed, newest first; corrupt lines are skipped."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(f"{path}/history").select("run_id", F.col("_metadata.file_modification_time").alias("written_at"))
    return rows.groupBy("run_id").agg(F.count("*").alias("rows"), F.max("written_at").alias("written_at")).orderBy(F.desc("written_at"), "run_id").limit(limit)


def augmentation_manifest(files: DataFrame, variations: list[str]) -> DataFrame:
    """Each file with each variation of a fixed list and the name its output gets."""
    return files.select("*", F.explode(F.array(*map(F.lit, variations))).alias("variation")).withColumn("output", F.concat_ws("_", "file_id", "variation"))


def text_report(df: DataFrame, title: str) -> DataFrame:
    """(line, text): a heading, the names of the columns and a line of text for every row, in the order of the columns."""
    rows = df.select(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]), " | ").alias("text"), F.struct(*df.columns).alias("by"))
    body = rows.withColumn("line", F.row_number().over(Window.orderBy("by")) + 2).select("line", "text")
    head = df.sparkSession.createDataFrame([(1, title), (2, " | ".join(df.columns))], "line int, text string")
    return head.unionByName(body)

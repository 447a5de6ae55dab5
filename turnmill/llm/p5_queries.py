"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.llm import personal
from turnmill.session import spread, table


def _segments(spark, sf_dir):
    return spread(table(spark, sf_dir, "transcribe_segments").where("file_id is not null and seq is not null").select("file_id", "seq", "text"))


def _references(spark, sf_dir):
    return spread(table(spark, sf_dir, "jangmin_result_no_prompt").where("result_id is not null").select("result_id", "reference"))


def p5_found(spark, sf_dir):
    # a re-delivered segment has the same text, so the few finds are made distinct, not all segments
    seg = personal.kinds(_segments(spark, sf_dir), "text", ["file_id", "seq"]).distinct()
    ref = personal.kinds(_references(spark, sf_dir), "reference", ["result_id"]).distinct()
    seg = seg.select(F.lit("transcribe_segments").alias("src_table"), F.concat_ws("#", "file_id", "seq").alias("row_key"), "kind")
    ref = ref.select(F.lit("jangmin_result_no_prompt").alias("src_table"), F.col("result_id").cast("string").alias("row_key"), "kind")
    return seg.unionByName(ref)


def p5_redacted(spark, sf_dir):
    # which rows deliver a segment again is told by keys alone, so texts aren't shuffled
    keys = table(spark, sf_dir, "transcribe_segments").where("file_id is not null and seq is not null").select("file_id", "seq", "row_id")
    again = keys.withColumn("n", F.row_number().over(Window.partitionBy("file_id", "seq").orderBy("row_id"))).where("n > 1").select("row_id")
    texts = table(spark, sf_dir, "transcribe_segments").where("file_id is not null and seq is not null").select("row_id", "file_id", "seq", "text")
    seg = personal.redacted(spread(texts).join(again, "row_id", "left_anti"), "text")
    ref = personal.redacted(_references(spark, sf_dir), "reference")
    seg = seg.select(F.lit("transcribe_segments").alias("src_table"), F.concat_ws("#", "file_id", "seq").alias("row_key"), "text")
    ref = ref.select(F.lit("jangmin_result_no_prompt").alias("src_table"), F.col("result_id").cast("string").alias("row_key"), F.col("reference").alias("text"))
    return seg.unionByName(ref)


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
ORACLES: dict[str, str] = {}

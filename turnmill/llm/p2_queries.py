"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.llm import truncation
from turnmill.session import spread, table

KEY = ["model_key", "result_id"]


def _scored(spark, sf_dir):
    cols = [*KEY, "source", F.col("hypothesis").alias("text"), "reference", "hyp_len"]
    a, b = (spread(table(spark, sf_dir, f"{m}_result_no_prompt").select(*cols)) for m in ("jangmin", "seastar105"))
    return truncation.scored(a.unionByName(b), KEY)


def p2_found(spark, sf_dir):
    return _scored(spark, sf_dir).where("cut").select(*KEY)


def p2_sources(spark, sf_dir):
    """For each source: its rows, those that are cut, and their share."""
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("rows"), F.count_if("cut").alias("cut_rows"), F.avg(F.col("cut").cast("double")).alias("cut_share"))


QUERIES = {"p2_found": p2_found, "p2_sources": p2_sources}
ORACLES: dict[str, str] = {}

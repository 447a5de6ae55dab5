"""Queries of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.llm import bpe, packing
from turnmill.session import cut_lineage, spread, table

#: pack_capacity lists the container sizes; more than this many would be no dimension table.
MOST_CAPACITIES = 100


def p6_ids(spark, sf_dir):
    return bpe.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_containers(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = cut_lineage(bpe.token_counts(docs))
    caps = table(spark, sf_dir, "pack_capacity").where("capacity_tokens > 0 and tokenizer = 'byte_bpe_50k'").select("capacity_id", "capacity_tokens").distinct().take(MOST_CAPACITIES + 1)
    if len(caps) > MOST_CAPACITIES:
        raise ValueError("pack_capacity has too many rows for a table of container sizes")
    return packing.pack(sizes, sorted((r[0], r[1]) for r in caps))


def p7_fill(spark, sf_dir):
    """Containers used, tokens held and the share of space used, for each capacity."""
    caps = table(spark, sf_dir, "pack_capacity").select("capacity_id", "capacity_tokens")
    per = p7_containers(spark, sf_dir).where("tokens > 0").groupBy("capacity_id", "container").agg(F.sum("tokens").alias("t"))
    per = per.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return per.join(caps, "capacity_id").select("capacity_id", "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


QUERIES = {"p6_ids": p6_ids, "p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}

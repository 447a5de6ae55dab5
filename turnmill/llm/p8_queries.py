"""Queries of problem 8."""

from __future__ import annotations

from turnmill.llm import mojibake
from turnmill.session import spread, table


def p8_found(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return mojibake.restored(docs).where("garbled").select("doc_id")


def p8_restored(spark, sf_dir):
    """Every document with its text as far as it can be had, and the two flags."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return mojibake.restored(docs).select("doc_id", "restored", "garbled", "beyond_repair")


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
ORACLES: dict[str, str] = {}

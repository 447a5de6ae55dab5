"""Queries of problem 4."""

from __future__ import annotations

from turnmill.llm import lookalike
from turnmill.session import spread, table


def _texts(spark, sf_dir):
    return spread(table(spark, sf_dir, "jangmin_result_no_prompt").select("result_id", "reference", "hypothesis"))


def p4_found(spark, sf_dir):
    return lookalike.alike_but_different(_texts(spark, sf_dir), "reference", "hypothesis", ["result_id"])


def p4_consistent(spark, sf_dir):
    return lookalike.consistent(_texts(spark, sf_dir), ["reference", "hypothesis"])


QUERIES = {"p4_found": p4_found, "p4_consistent": p4_consistent}
ORACLES: dict[str, str] = {}

"""Queries of problem 1."""

from __future__ import annotations

from turnmill.llm import turns
from turnmill.session import spread, table


def _segments(spark, sf_dir):
    return spread(table(spark, sf_dir, "transcribe_segments").select("file_id", "seq", "start", "text", "speaker"))


def p1_found(spark, sf_dir):
    return turns.turn_starts(_segments(spark, sf_dir), table(spark, sf_dir, "role_codes"))


def p1_turns(spark, sf_dir):
    return turns.turns(_segments(spark, sf_dir), table(spark, sf_dir, "role_codes"))


QUERIES = {"p1_found": p1_found, "p1_turns": p1_turns}
ORACLES: dict[str, str] = {}

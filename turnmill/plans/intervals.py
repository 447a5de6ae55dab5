"""Queries of problem 3: periods and gaps of the recordings' segments."""

from __future__ import annotations

from turnmill.operators import intervals
from turnmill.session import table


def p3_found(spark, sf_dir):
    return intervals.gaps(table(spark, sf_dir, "transcribe_segments"), "file_id", "start", "end")


def p3_periods(spark, sf_dir):
    return intervals.periods(table(spark, sf_dir, "transcribe_segments"), "file_id", "start", "end")


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods}

_SPANS = """
WITH spans AS (
  SELECT file_id, CAST(floor("start" * 1000 + 0.5) AS BIGINT) AS s, CAST(floor("end" * 1000 + 0.5) AS BIGINT) AS e
  FROM transcribe_segments
  WHERE "start" < "end" AND NOT isnan("start") AND NOT isnan("end")
), reach AS (
  SELECT file_id, s, e, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM spans WHERE s < e
)"""

ORACLES = {
    "p3_found": _SPANS
    + """
SELECT file_id, before AS gap_start_ms, s AS gap_end_ms FROM reach WHERE s > before AND s - before < 3600000""",
    "p3_periods": _SPANS
    + """, islands AS (
  SELECT file_id, s, e, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e) AS island FROM reach
)
SELECT file_id, min(s) AS period_start_ms, max(e) AS period_end_ms FROM islands GROUP BY file_id, island""",
}

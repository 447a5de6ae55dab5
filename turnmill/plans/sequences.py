"""Queries of the sequence operators over transcript segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import sequences as S
from turnmill.session import table

SEGMENTS_SQL = """seg AS (SELECT file_id, seq, "start", "end", text, speaker, confidence FROM transcribe_segments
  WHERE file_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, seq ORDER BY row_id) = 1)"""


def segments(spark, sf_dir):
    return S.once(table(spark, sf_dir, "transcribe_segments").select("file_id", "seq", "start", "end", "text", "speaker", "confidence"))


def _kind(c="speaker"):
    """A coarse speaker label: digits of the diarizer, else the lowered text."""
    return F.lower(F.trim(c))


QUERIES = {
    "seq1_time_gaps": lambda s, d: S.time_gaps(segments(s, d), table(s, d, "recordings")),
    "seq2_without_repeats": lambda s, d: S.without_repeats(segments(s, d)).select("file_id", "seq", "text"),
    "seq3_merged_same_speaker": lambda s, d: S.merged_same_speaker(segments(s, d)),
    "seq4_runs": lambda s, d: S.runs(segments(s, d).withColumn("who", _kind()), "who"),
    "seq4_longest_run": lambda s, d: S.runs(segments(s, d).withColumn("who", _kind()), "who").groupBy("file_id").agg(F.max("length").alias("longest"), F.count_if(F.col("length") >= 3).alias("long_runs")),
    "seq5_run_expansion": lambda s, d: S.spread(S.with_runs(segments(s, d).select("file_id", "seq", _kind().alias("who")), "who"), F.col("run_length") >= 3).where("marked").select("file_id", "seq"),
    "seq8_filled": lambda s, d: S.filled(segments(s, d).withColumn("phase", F.when(F.col("text").contains("검사"), F.lit("exam")).when(F.col("text").contains("약"), F.lit("drug"))), "phase", "filled").select("file_id", "seq", "filled"),
    "seq12_context": lambda s, d: S.context(segments(s, d), 2, 2),
    "seq13_context_radius3": lambda s, d: S.context(segments(s, d).withColumn("text", F.when(F.trim("text") != "", F.col("text"))), 3, 3),
    "seq15_windows": lambda s, d: S.overlapping_windows(segments(s, d)).select("file_id", "seq", F.col("window").cast("bigint").alias("window")),
    "seq16_batches": lambda s, d: S.batches(segments(s, d), 40).select("file_id", "seq", "place", F.col("batch").cast("bigint").alias("batch")),
    "seq18_continuity": lambda s, d: S.continuity(segments(s, d)),
    "seq20_first_speakers": lambda s, d: S.first_occurrences(segments(s, d), ["file_id"], "speaker", ["seq"], 50),
}

_RUNS = f"""WITH {SEGMENTS_SQL}, m AS (SELECT *, lower(trim(speaker, ' ')) AS who FROM seg),
 n AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR who IS DISTINCT FROM lag(who) OVER w THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY seq) AS run FROM n),
 r AS (SELECT file_id, run, min(who) AS value, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS length FROM i GROUP BY file_id, run)"""

_PLACED = f"WITH {SEGMENTS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS place FROM seg)"

ORACLES = {
    "seq1_time_gaps": f"""WITH {SEGMENTS_SQL}, t AS (SELECT *, lag("end") OVER w AS prev_end, row_number() OVER w AS rn, row_number() OVER (PARTITION BY file_id ORDER BY "start" DESC, seq DESC) AS back
 FROM seg WHERE "start" IS NOT NULL AND "end" IS NOT NULL WINDOW w AS (PARTITION BY file_id ORDER BY "start", seq))
SELECT file_id, 'inner' AS place, prev_end AS gap_start, "start" AS gap_end FROM t WHERE "start" - prev_end >= 1.0
UNION ALL SELECT file_id, 'head', 0.0, "start" FROM t WHERE rn = 1 AND "start" > 1.0
UNION ALL SELECT t.file_id, 'tail', "end", duration_s FROM t JOIN recordings r USING (file_id) WHERE back = 1 AND duration_s - "end" > 1.0""",
    "seq2_without_repeats": f"""WITH {SEGMENTS_SQL} SELECT file_id, seq, text FROM seg WINDOW w AS (PARTITION BY file_id ORDER BY seq)
 QUALIFY text IS NULL OR lag(trim(text, ' ')) OVER w IS NULL OR lag(trim(text, ' ')) OVER w <> trim(text, ' ')""",
    "seq3_merged_same_speaker": f"""WITH {SEGMENTS_SQL}, k AS (SELECT * FROM seg),
 n AS (SELECT *, CASE WHEN lag("end") OVER w IS NOT NULL AND speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND "start" - lag("end") OVER w < 0.2 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY seq) AS island FROM n)
SELECT file_id, island, min(seq) AS first_seq, first(speaker ORDER BY seq) AS speaker, first("start" ORDER BY seq) AS "start", last("end" ORDER BY seq) AS "end", min(confidence) AS confidence,
 count(*) AS segments, coalesce(string_agg(text, ' ' ORDER BY seq), '') AS text FROM i GROUP BY file_id, island""",
    "seq4_runs": _RUNS + " SELECT * FROM r",
    "seq4_longest_run": _RUNS + " SELECT file_id, max(length) AS longest, count(*) FILTER (length >= 3) AS long_runs FROM r GROUP BY file_id",
    "seq5_run_expansion": _RUNS + """, l AS (SELECT *, count(*) OVER (PARTITION BY file_id, run) AS n FROM i), e AS (SELECT file_id, seq, max(CASE WHEN n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l) SELECT file_id, seq FROM e WHERE near = 1""",
    "seq8_filled": f"""WITH {SEGMENTS_SQL}, m AS (SELECT *, CASE WHEN contains(text, '검사') THEN 'exam' WHEN contains(text, '약') THEN 'drug' END AS phase FROM seg)
SELECT file_id, seq, coalesce(last_value(phase IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq), first_value(phase IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM m""",
    "seq12_context": _PLACED
    + """ SELECT a.file_id, a.seq, coalesce(string_agg(b.text, ' ' ORDER BY b.place), '') AS context FROM p a LEFT JOIN p b ON a.file_id = b.file_id AND b.place BETWEEN a.place - 2 AND a.place + 2 AND b.place <> a.place AND b.text IS NOT NULL GROUP BY a.file_id, a.seq""",
    "seq13_context_radius3": _PLACED
    + """ SELECT a.file_id, a.seq, coalesce(string_agg(b.text, ' ' ORDER BY b.place), '') AS context FROM p a LEFT JOIN p b ON a.file_id = b.file_id AND b.place BETWEEN a.place - 3 AND a.place + 3 AND b.place <> a.place AND trim(b.text, ' ') <> '' GROUP BY a.file_id, a.seq""",
    "seq15_windows": f"""WITH {SEGMENTS_SQL}, w AS (SELECT file_id, seq, "start", "end", unnest(generate_series(CAST(floor("start" / 60.0) AS BIGINT), CAST(floor(("end" + 2.0) / 60.0) AS BIGINT))) AS "window" FROM seg WHERE "start" IS NOT NULL AND "end" > "start")
SELECT file_id, seq, "window" FROM w WHERE "end" > greatest("window" * 60.0 - 2.0, 0.0) AND "start" < ("window" + 1) * 60.0 AND ("window" = 0 OR "end" > "window" * 60.0)""",
    "seq16_batches": _PLACED + " SELECT file_id, seq, place, (place - 1) // 40 AS batch FROM p",
    "seq18_continuity": f"WITH {SEGMENTS_SQL} SELECT file_id, count(*) AS rows, min(seq) AS lowest, max(seq) AS highest, min(seq) = 1 AND max(seq) - min(seq) + 1 = count(*) AS continuous FROM seg GROUP BY file_id",
    "seq20_first_speakers": f"""WITH {SEGMENTS_SQL}, f AS (SELECT file_id, speaker, min(seq) AS first_at FROM seg WHERE speaker IS NOT NULL GROUP BY file_id, speaker)
SELECT file_id, speaker, row_number() OVER (PARTITION BY file_id ORDER BY first_at, speaker) AS place FROM f QUALIFY place <= 50""",
}

"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import joins as J
from turnmill.operators import sequences as S
from turnmill.plans.sequences import SEGMENTS_SQL, segments
from turnmill.session import table

KEYWORDS = ["검사", "혈압", "통증", "복통", "기침", "수술", "체온"]


def _turns(s, d):
    """Merged runs of one speaker play the diarizer's turns, in order of their first segment."""
    return S.merged_same_speaker(segments(s, d)).select("file_id", F.col("first_seq").alias("ord"), "start", "end", "speaker")


def j1(s, d):
    return J.speaker_of_segments(segments(s, d), _turns(s, d))


def _words(s, d):
    e = table(s, d, "medical_dict_entries")
    return e.where("wrong is not null").select(F.col("wrong").alias("word")), e.where("correct is not null").select(F.col("correct").alias("term"))


def j5_anti(s, d):
    words, terms = _words(s, d)
    said = table(s, d, "transcribe_segments").select(F.explode(F.regexp_extract_all("text", F.lit(r"([가-힣]{2,})"), 1)).alias("word")).distinct()
    return said.join(terms.withColumnRenamed("term", "word"), "word", "left_anti").join(words, "word", "left_anti")


def _results(s, d, m):
    t = table(s, d, f"{m}_result_no_prompt")
    return t.groupBy("run_id", "type").agg(F.min_by("cer", "result_id").alias("cer"), F.min_by("hypothesis", "result_id").alias("hypothesis"))


def j6(s, d):
    base = table(s, d, "seastar105_result_no_prompt").select("result_id", "run_id", "type", "cer")
    return J.first_match(base, table(s, d, "jangmin_result_no_prompt"), ["run_id", "type"], "result_id", ["cer", "source"]).withColumn("missing", F.col("right_cer").isNull())


def j7(s, d):
    return J.zipped(_results(s, d, "jangmin"), _results(s, d, "seastar105"), ["run_id", "type"], "hypothesis", "[none]")


def j9(s, d):
    return J.compared(_results(s, d, "jangmin"), _results(s, d, "seastar105"), ["run_id", "type"], "cer", 1.0)


def j13(s, d):
    seg = segments(s, d)
    return seg.select("file_id", "seq", J.keyword_hits(F.col("text"), KEYWORDS).cast("int").alias("hits")).where("hits > 0")


def j14(s, d):
    seg = segments(s, d).groupBy("file_id").agg(F.count("*").alias("segments"))
    return seg.join(table(s, d, "recordings").select("file_id", "type_num", "specialty"), "file_id", "left").select("file_id", "segments", F.coalesce("type_num", F.lit(0)).alias("type_num"), F.coalesce("specialty", F.lit("none")).alias("specialty"))


def j15(s, d):
    types = table(s, d, "recordings").where("type_num is not null").select("type_num").distinct()
    # a fixed grid of four settings beside each type, without a join
    grid = F.array(*[F.struct(F.lit(b).alias("beam"), F.lit(e).alias("enhanced")) for b in (5, 10) for e in (False, True)])
    return types.select("type_num", F.inline(grid))


def j16(s, d):
    rows = _results(s, d, "jangmin").withColumn("model", F.lit("jangmin")).unionByName(_results(s, d, "seastar105").withColumn("model", F.lit("seastar105")))
    wide = rows.groupBy("run_id", "type").pivot("model", ["jangmin", "seastar105"]).agg(F.min("cer"))
    best = F.when(F.col("jangmin").isNull() & F.col("seastar105").isNull(), None).when(F.col("seastar105").isNull() | (F.col("jangmin") <= F.col("seastar105")), "jangmin").otherwise("seastar105")
    return wide.withColumn("best", best)


def so1(s, d):
    a, b = (table(s, d, f"{m}_result_no_prompt").select("run_id", "type") for m in ("jangmin", "seastar105"))
    return a.union(b).distinct()


def so2(s, d):
    cols = ["result_id", "model_key", "source", "hypothesis"]
    a, b = (table(s, d, f"{m}_result_no_prompt").select(*cols) for m in ("jangmin", "seastar105"))
    return a.unionByName(b).where("hypothesis is not null and trim(hypothesis) <> ''")


def so4(s, d):
    from turnmill.functions.text import char_jaccard

    return table(s, d, "seastar105_result_no_prompt").where("reference is not null and hypothesis is not null").select("result_id", F.round(char_jaccard(F.col("reference"), F.col("hypothesis")), 6).alias("jaccard"))


def so5(s, d):
    found = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"([가-힣]+정)"), 1), F.regexp_extract_all("text", F.lit(r"([가-힣]+캡슐)"), 1), F.regexp_extract_all("text", F.lit(r"([가-힣]+검사)"), 1))))
    return segments(s, d).where("text is not null").select("file_id", "seq", F.explode(found).alias("term"))


QUERIES = {
    "j1_interval_speaker": j1,
    "j5_unknown_words": j5_anti,
    "j6_first_match": j6,
    "j7_zipped": j7,
    "j9_compared_runs": j9,
    "j13_keyword_hits": j13,
    "j14_dimension_lookup": j14,
    "j15_parameter_grid": j15,
    "j16_model_matrix": j16,
    "so1_key_union": so1,
    "so2_bag_union": so2,
    "so4_char_jaccard": so4,
    "so5_term_union": so5,
}

_RES = """r AS (SELECT 'jangmin' AS model, run_id, type, arg_min(cer, result_id) AS cer, arg_min(hypothesis, result_id) AS hypothesis FROM jangmin_result_no_prompt GROUP BY run_id, type
 UNION ALL SELECT 'seastar105', run_id, type, arg_min(cer, result_id), arg_min(hypothesis, result_id) FROM seastar105_result_no_prompt GROUP BY run_id, type),
 a AS (SELECT * FROM r WHERE model = 'jangmin'), b AS (SELECT * FROM r WHERE model = 'seastar105')"""
_SAID = "said AS (SELECT unnest(regexp_extract_all(text, '[가-힣]{2,}')) AS word FROM transcribe_segments)"
_CHARS = "list_distinct(list_filter(string_split(regexp_replace({}, '\\s', '', 'g'), ''), lambda x: x <> ''))"

ORACLES = {
    "j1_interval_speaker": f"""WITH {SEGMENTS_SQL}, n AS (SELECT *, CASE WHEN lag("end") OVER w IS NOT NULL AND speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND "start" - lag("end") OVER w < 0.2 THEN 0 ELSE 1 END AS fresh FROM seg WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY seq) AS island FROM n), m AS (SELECT file_id, min(seq) AS ord, first(speaker ORDER BY seq) AS speaker, first("start" ORDER BY seq) AS "start", last("end" ORDER BY seq) AS "end" FROM i GROUP BY file_id, island), t AS (SELECT * FROM m WHERE "start" <= "end"),
 p AS (SELECT a.file_id, a.seq, t.ord, t.speaker, (a."start" + a."end") / 2 BETWEEN t."start" AND t."end" AS stab, least(a."end", t."end") - greatest(a."start", t."start") AS overlap
  FROM seg a JOIN t ON a.file_id = t.file_id AND a."start" <= a."end" AND t."start" <= a."end" AND t."end" >= a."start"),
 x AS (SELECT * FROM p WHERE stab OR overlap >= 0.05 QUALIFY row_number() OVER (PARTITION BY file_id, seq ORDER BY stab DESC, CASE WHEN stab THEN 0.0 ELSE -overlap END, ord) = 1)
SELECT a.file_id, a.seq, x.speaker FROM seg a LEFT JOIN x ON a.file_id = x.file_id AND a.seq = x.seq""",
    "j5_unknown_words": f"WITH {_SAID} SELECT DISTINCT word FROM said WHERE word NOT IN (SELECT correct FROM medical_dict_entries WHERE correct IS NOT NULL) AND word NOT IN (SELECT wrong FROM medical_dict_entries WHERE wrong IS NOT NULL)",
    "j6_first_match": """WITH f AS (SELECT run_id, type, arg_min_null(cer, result_id) AS right_cer, arg_min_null(source, result_id) AS right_source FROM jangmin_result_no_prompt GROUP BY run_id, type)
SELECT s.run_id, s.type, s.result_id, s.cer, right_cer, right_source, right_cer IS NULL AS missing FROM seastar105_result_no_prompt s LEFT JOIN f USING (run_id, type)""",
    "j7_zipped": f"""WITH {_RES} SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.type, b.type) AS type, coalesce(a.hypothesis, '[none]') AS left_value, coalesce(b.hypothesis, '[none]') AS right_value,
 a.hypothesis IS NULL OR b.hypothesis IS NULL AS missing FROM a FULL JOIN b ON a.run_id = b.run_id AND a.type = b.type""",
    "j9_compared_runs": f"""WITH {_RES}, d AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.type, b.type) AS type, a.cer AS before, b.cer AS after, round(b.cer - a.cer, 4) AS diff FROM a FULL JOIN b ON a.run_id = b.run_id AND a.type = b.type)
SELECT *, CASE WHEN diff IS NULL THEN 'no_data' WHEN diff > 1.0 THEN 'worse' WHEN diff < -1.0 THEN 'better' ELSE 'same' END AS status FROM d""",
    "j13_keyword_hits": f"WITH {SEGMENTS_SQL}, h AS (SELECT file_id, seq, " + " + ".join(f"CASE WHEN contains(text, '{k}') THEN 1 ELSE 0 END" for k in KEYWORDS) + " AS hits FROM seg) SELECT * FROM h WHERE hits > 0",
    "j14_dimension_lookup": f"WITH {SEGMENTS_SQL} SELECT s.file_id, count(*) AS segments, coalesce(any_value(type_num), 0) AS type_num, coalesce(any_value(specialty), 'none') AS specialty FROM seg s LEFT JOIN recordings r USING (file_id) GROUP BY s.file_id",
    "j15_parameter_grid": "SELECT type_num, beam, enhanced FROM (SELECT DISTINCT type_num FROM recordings WHERE type_num IS NOT NULL), (VALUES (5), (10)) b(beam), (VALUES (false), (true)) e(enhanced)",
    "j16_model_matrix": f"""WITH {_RES}, w AS (SELECT run_id, type, min(cer) FILTER (model = 'jangmin') AS jangmin, min(cer) FILTER (model = 'seastar105') AS seastar105 FROM r GROUP BY run_id, type)
SELECT *, CASE WHEN jangmin IS NULL AND seastar105 IS NULL THEN NULL WHEN seastar105 IS NULL OR jangmin <= seastar105 THEN 'jangmin' ELSE 'seastar105' END AS best FROM w""",
    "so1_key_union": "SELECT run_id, type FROM jangmin_result_no_prompt UNION SELECT run_id, type FROM seastar105_result_no_prompt",
    "so2_bag_union": "SELECT result_id, model_key, source, hypothesis FROM (FROM jangmin_result_no_prompt UNION ALL FROM seastar105_result_no_prompt) WHERE trim(hypothesis, ' ') <> ''",
    "so4_char_jaccard": f"""WITH c AS (SELECT result_id, {_CHARS.format('reference')} AS a, {_CHARS.format('hypothesis')} AS b FROM seastar105_result_no_prompt WHERE reference IS NOT NULL AND hypothesis IS NOT NULL)
SELECT result_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM c""",
    "so5_term_union": f"""WITH {SEGMENTS_SQL} SELECT file_id, seq, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(text, '[가-힣]+정'), regexp_extract_all(text, '[가-힣]+캡슐')), regexp_extract_all(text, '[가-힣]+검사')))) AS term FROM seg WHERE text IS NOT NULL""",
}

"""Queries of text functions, rewrite rules and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.plans import joined
from turnmill.functions import cleaning as C
from turnmill.functions import text as T
from turnmill.operators import folds, rules
from turnmill.plans.sequences import SEGMENTS_SQL, segments
from turnmill.session import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _refs(s, d):
    return table(s, d, "jangmin_result_no_prompt").where("reference is not null").select("result_id", "reference")


@query("n1_normal", "SELECT result_id, trim(regexp_replace(translate(nfc_normalize(reference), '。，？！·', '.,?! '), '\\s+', ' ', 'g'), ' ') AS t FROM jangmin_result_no_prompt WHERE reference IS NOT NULL")
def _(s, d):
    return _refs(s, d).select("result_id", T.n1(F.col("reference")).alias("t"))


@query("n3_bare", "SELECT result_id, regexp_replace(reference, '\\s', '', 'g') AS t FROM jangmin_result_no_prompt WHERE reference IS NOT NULL")
def _(s, d):
    return _refs(s, d).select("result_id", T.n3(F.col("reference")).alias("t"))


@query("n8_counted", "SELECT result_id, length(translate(nfc_normalize(reference), ' ' || chr(10) || chr(9), '')) AS n FROM jangmin_result_no_prompt WHERE reference IS NOT NULL")
def _(s, d):
    return _refs(s, d).select("result_id", F.length(T.n8(F.col("reference"))).alias("n"))


@query("n2_words", f"WITH {SEGMENTS_SQL} SELECT file_id, seq, list_filter(string_split(regexp_replace(regexp_replace(text, '[.,!?;:\"''()\\[\\]{{}}…·\\-–—]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM seg WHERE text IS NOT NULL")
def _(s, d):
    return segments(s, d).where("text is not null").select("file_id", "seq", T.n2_words(F.col("text")).alias("words"))



@query("n7_normal", "SELECT result_id, lower(regexp_replace(nfc_normalize(reference), '[^\\p{L}\\p{N}_]', '', 'g')) AS t FROM jangmin_result_no_prompt WHERE reference IS NOT NULL")
def _(s, d):
    return _refs(s, d).select("result_id", T.n7(F.col("reference")).alias("t"))


_J = "list_transform(list_filter(string_split({}, ''), lambda x: x <> ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN substr('" + T.LEADS + "', (unicode(c) - 44032) // 588 + 1, 1) || substr('" + T.VOWELS + "', ((unicode(c) - 44032) % 588) // 28 + 1, 1) || CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN substr('" + T.TAILS + "', (unicode(c) - 44032) % 28 + 1, 1) ELSE '' END ELSE c END)"


@query("m11_jamo", f"SELECT id, array_to_string({_J.format('wrong')}, '') AS letters FROM medical_dict_entries")
def _(s, d):
    return table(s, d, "medical_dict_entries").select("id", T.jamo(F.col("wrong")).alias("letters"))


@query("t22_medical_terms", f"WITH {SEGMENTS_SQL} SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '[가-힣]+(?:캡슐|시럽|연고|내시경|초음파)')) AS term FROM seg) GROUP BY term")
def _(s, d):
    return segments(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"([가-힣]+(?:캡슐|시럽|연고|내시경|초음파))"), 1)).alias("term")).groupBy("term").agg(F.count("*").alias("times"))


@query("t26_word_positions", f"WITH {SEGMENTS_SQL}, w AS (SELECT file_id, seq, regexp_extract_all(text, '[가-힣]{{2,}}') AS w FROM seg), p AS (SELECT file_id, seq, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM w) SELECT file_id, seq, word, min(place) AS place FROM p GROUP BY file_id, seq, word")
def _(s, d):
    w = segments(s, d).select("file_id", "seq", F.posexplode(F.regexp_extract_all("text", F.lit("([가-힣]{2,})"), 1)).alias("place", "word"))
    return w.groupBy("file_id", "seq", "word").agg(F.min("place").alias("place"))


# rules -------------------------------------------------------------------


def _entries(s, d):
    return table(s, d, "medical_dict_entries")


@query("c12_rule_upsert", "SELECT id, wrong, correct, CASE WHEN priority < 60 THEN 60 ELSE priority END AS priority FROM medical_dict_entries")
def _(s, d):
    e = _entries(s, d).select("id", "wrong", "correct", "priority")
    changes = e.where("priority < 60").select("id", F.lit(60).alias("priority"))
    return rules.upserted(e, changes)


# folds -------------------------------------------------------------------

# One step a segment in the order of a file: the last kept one is carried, and every one kept opens a slot whose last holder stays.
_FOLD = """WITH RECURSIVE {seg}, b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY "start", seq) AS rn FROM seg WHERE "start" IS NOT NULL AND "end" IS NOT NULL),
 step AS (
  SELECT file_id, rn, seq AS kept, "start" AS s, "end" AS e, text AS t, 1::BIGINT AS slot FROM b WHERE rn = 1
  UNION ALL
  SELECT b.file_id, b.rn, CASE act WHEN 2 THEN kept ELSE seq END, CASE act WHEN 2 THEN s ELSE "start" END, CASE act WHEN 2 THEN e ELSE "end" END, CASE act WHEN 2 THEN t ELSE text END, slot + CASE act WHEN 0 THEN 1 ELSE 0 END
  FROM (SELECT b.*, step.kept, step.s, step.e, step.t, step.slot, {act} AS act FROM step JOIN b ON b.file_id = step.file_id AND b.rn = step.rn + 1) b
 ), held AS (SELECT file_id, kept AS seq FROM step QUALIFY row_number() OVER (PARTITION BY file_id, slot ORDER BY rn DESC) = 1)
SELECT file_id, seq, "start", "end", text FROM seg WHERE "start" IS NULL OR "end" IS NULL OR (file_id, seq) IN (SELECT (file_id, seq) FROM held)"""
_OVERLAP = """CASE WHEN "end" > "start" AND (least(step.e, "end") - greatest(step.s, "start")) / ("end" - "start") > 0.5 THEN CASE WHEN length(coalesce(text, '')) > length(coalesce(step.t, '')) THEN 1 ELSE 2 END ELSE 0 END"""
_X, _P = "trim(coalesce(text, ''), ' ')", "trim(coalesce(step.t, ''), ' ')"
_TAILS = " OR ".join(f"(length({_X}) >= {k} AND length({_P}) >= {k} AND right({_P}, {k}) = left({_X}, {k}))" for k in range(6, 13))
_REPEAT = f"""CASE WHEN {_X} <> '' AND {_P} <> '' AND "start" <= step.e + 0.35 AND ({_X} = {_P} OR (least(length({_X}), length({_P})) >= 6 AND (contains({_X}, {_P}) OR contains({_P}, {_X}))) OR {_TAILS}) THEN 2 ELSE 0 END"""


@query("seq6_without_overlaps", _FOLD.format(seg=SEGMENTS_SQL, act=_OVERLAP))
def _(s, d):
    return folds.without_overlaps(segments(s, d))


@query("seq7_without_chunk_repeats", _FOLD.format(seg=SEGMENTS_SQL, act=_REPEAT))
def _(s, d):
    return folds.without_chunk_repeats(segments(s, d))


joined(QUERIES, ORACLES, "n2_words", "words")

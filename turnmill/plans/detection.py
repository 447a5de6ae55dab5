"""Queries of context glossaries and unseen word pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import detection as D
from turnmill.operators import sequences as S
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


def _said(s, d):
    return segments(s, d).where("text is not null")


_WINDOW = f"""WITH {SEGMENTS_SQL}, t AS (SELECT file_id, seq, text, nullif(trim(text, ' '), '') AS x FROM seg), win AS (SELECT file_id, seq, text, coalesce(string_agg(x, ' ') OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), '') AS win FROM t)"""


def _has(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _glossary_sql():
    out = "text"
    for r in D.GLOSSARY_RULES:
        longest = sorted(r["candidates"], key=len, reverse=True)
        pick = "CASE " + " ".join(f"WHEN contains(win, '{c}') THEN '{c}'" for c in longest) + " " + (f"WHEN {_has('win', r['needs'])} AND contains(win, '{r['head']}') THEN '{r['candidates'][0]}' WHEN contains(win, '{r['head']}') THEN '{r['head']}'" if r["head"] else "") + f" ELSE '{r['candidates'][0]}' END"
        out = f"CASE WHEN {_has('win', r['anchors'])} THEN regexp_replace({out}, '{r['pattern']}', {pick}) ELSE {out} END"
    return out


@query("t23_glossary_first", f"{_WINDOW} SELECT file_id, seq, {_glossary_sql()} AS text FROM win WHERE trim(text, ' ') <> ''")
def _(s, d):
    near = S.context(segments(s, d).withColumn("text", F.nullif(F.trim("text"), F.lit(""))), 3, 3, own=True).withColumnRenamed("context", "near")
    both = _said(s, d).where("trim(text) <> ''").join(near, ["file_id", "seq"])
    return both.select("file_id", "seq", D.glossary_corrected(F.col("text"), F.col("near")).alias("text"))


_W = "list_filter(string_split({}, ' '), lambda x: x <> '')"


@query("seq19_unseen_pairs", f"""WITH h AS (SELECT result_id, {_W.format('hypothesis')} AS w FROM seastar105_result_no_prompt WHERE hypothesis IS NOT NULL), r AS (SELECT {_W.format('reference')} AS w FROM jangmin_result_no_prompt WHERE reference IS NOT NULL),
 hp AS (SELECT result_id, w[i] AS a, w[i + 1] AS b FROM (SELECT result_id, w, unnest(range(1, len(w))) AS i FROM h)), rp AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM r)), k AS (SELECT DISTINCT unnest(w) AS a FROM r)
SELECT DISTINCT result_id, a, b FROM hp WHERE a IN (SELECT a FROM k) AND NOT EXISTS (SELECT 1 FROM rp WHERE rp.a = hp.a AND rp.b = hp.b)""")
def _(s, d):
    texts = table(s, d, "seastar105_result_no_prompt").select("result_id", F.col("hypothesis").alias("text"))
    return D.unseen_pairs(texts, table(s, d, "jangmin_result_no_prompt").select(F.col("reference").alias("text")), ["result_id"])

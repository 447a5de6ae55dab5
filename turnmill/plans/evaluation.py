"""Queries of error rates, evaluations, comparisons of runs and language model scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.functions import metrics as M
from turnmill.functions import text as T
from turnmill.operators import detection as D
from turnmill.operators import joins as J
from turnmill.session import spread, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def texts(s, d):
    """Both tables of results; every result once, whole texts."""
    cols = ["result_id", "run_id", "model_key", "type", "source", "cer", "ref_len", "hyp_len", "reference", "hypothesis"]
    a, b = (spread(table(s, d, f"{m}_result_no_prompt").select(*cols)) for m in ("jangmin", "seastar105"))
    return a.unionByName(b)


TEXTS_SQL = "texts AS (SELECT result_id, run_id, model_key, type, source, cer, ref_len, hyp_len, reference, hypothesis FROM (FROM jangmin_result_no_prompt UNION ALL FROM seastar105_result_no_prompt))"


# Normal forms in SQL ------------------------------------------------------

def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def n1_sql(c):
    return f"trim(regexp_replace(translate(nfc_normalize({c}), '。，？！·', '.,?! '), '\\s+', ' ', 'g'), ' ')"


def n4_sql(c):
    return f"lower(regexp_replace(regexp_replace(regexp_replace(trim(nfc_normalize({c}), ' '), '{T.GLOSS_OF_N4}', '\\1', 'g'), '\\s+', ' ', 'g'), '{_quoted(T.MARKS_OF_N4)}', '', 'g'))"


def _marks_dropped_sql(c):
    return f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({c}), '{T.GLOSS_OF_N5}', '\\1', 'g'), '{T.LATIN_IN_BRACKETS}', '', 'g'), '{_quoted(T.MARKS_OF_N5)}', '', 'g')"


def n5_sql(c):
    return f"lower(regexp_replace({_marks_dropped_sql(c)}, '\\s+', '', 'g'))"


def n6_sql(c):
    """Words and what is between them apart: a lone sound is a word of its own, and a word's last 요 is at its end."""
    parts = f"regexp_extract_all({_marks_dropped_sql(c)}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    kept = f"list_filter({parts}, lambda w: w NOT IN ({', '.join(repr(x) for x in T.SOUNDS_OF_N6)}))"
    t = f"array_to_string({kept}, '')"
    for a, b in T.ENDINGS_OF_N6:
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    ends = f"list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_replace(w, '요$', ''))"
    return f"lower(regexp_replace(array_to_string({ends}, ''), '\\s+', '', 'g'))"


def words_sql(c):
    return f"list_filter(string_split(trim(regexp_replace(regexp_replace({c}, '{_quoted(T.MARKS_OF_WORDS)}', ' ', 'g'), '\\s+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"


def split_sql(c, by=""):
    return f"list_filter(string_split({c}, '{by}'), lambda w: w <> '')"


def distance_sql(r="r", h="h"):
    """Edit distance of two lists whose common items are in ``shared``: each gets a byte of its own, all others one a side."""
    code = lambda x, other: f"array_to_string(list_transform({x}, lambda w: chr(CAST(CASE WHEN list_contains(shared, w) THEN 2 + list_position(shared, w) ELSE {other} END AS INTEGER))), '')"
    return f"levenshtein({code(r, 1)}, {code(h, 2)})"


SHARED = "list_distinct(list_intersect(r, h)) AS shared"


def paired_sql(ref, hyp, of="texts"):
    """CTE ``c``: the rows with the lists r and h and what they share."""
    return f"p AS (SELECT *, {ref} AS r, {hyp} AS h FROM {of}), c AS (SELECT *, {SHARED} FROM p)"


for _name, _form, _sql in (("n4_normal", T.n4, n4_sql), ("n5_normal", T.n5, n5_sql), ("n6_normal", T.n6, n6_sql)):
    query(_name, f"WITH {TEXTS_SQL} SELECT result_id, {_sql('reference')} AS ref, {_sql('hypothesis')} AS hyp FROM texts")(
        lambda s, d, form=_form: texts(s, d).select("result_id", form(F.col("reference")).alias("ref"), form(F.col("hypothesis")).alias("hyp"))
    )


@query("h1_text", f"WITH {TEXTS_SQL} SELECT result_id, coalesce(nullif(trim(hypothesis, ' '), ''), nullif(trim(reference, ' '), ''), '') AS text FROM texts")
def _(s, d):
    return texts(s, d).select("result_id", T.coalesced(F.col("hypothesis"), F.col("reference")).alias("text"))


# error rates --------------------------------------------------------------


@query("m1_operations")
def _(s, d):
    """The operations of the least edit of every result's words, in order, and the same with insertions first in ties."""
    r, h = F.col("reference"), F.col("hypothesis")
    x = texts(s, d).select("result_id", M.aligned(M.words(r), M.words(h)).alias("x"), M.aligned(M.words(r), M.words(h), insertion_first=True).alias("y"))
    both = [F.col(f"x.{c}").alias(c) for c in M.OPS.names] + [F.col(f"y.{c}").alias(f"{c}_m4") for c in ("substitutions", "deletions", "insertions")]
    return x.select("result_id", *both)


_CHARS = (split_sql(f"replace({n1_sql('reference')}, ' ', '')"), split_sql(f"replace({n1_sql('hypothesis')}, ' ', '')"))
_WORDS = (split_sql(n1_sql("reference"), " "), split_sql(n1_sql("hypothesis"), " "))


@query("m2_character_errors", f"WITH {TEXTS_SQL}, {paired_sql(*_CHARS)} SELECT result_id, {distance_sql()} AS distance, len(r) AS ref_length, len(h) AS hyp_length, round({distance_sql()} / greatest(len(r), 1), 6) AS rate FROM c WHERE reference IS NOT NULL AND hypothesis IS NOT NULL")
def _(s, d):
    r, h = M.characters(F.col("reference")), M.characters(F.col("hypothesis"))
    x = texts(s, d).where("reference is not null and hypothesis is not null").select("result_id", F.array_join(r, "").alias("r"), F.array_join(h, "").alias("h"))
    n = F.length("r").cast("bigint")
    k = F.levenshtein("r", "h").cast("bigint")
    return x.select("result_id", k.alias("distance"), n.alias("ref_length"), F.length("h").cast("bigint").alias("hyp_length"), F.round(M.rate(k, n), 6).alias("rate"))


@query("m3_word_errors", f"WITH {TEXTS_SQL}, {paired_sql(*_WORDS)} SELECT result_id, {distance_sql()} AS distance, len(r) AS ref_length, len(h) AS hyp_length, round({distance_sql()} / greatest(len(r), 1), 6) AS rate FROM c WHERE reference IS NOT NULL AND hypothesis IS NOT NULL")
def _(s, d):
    x = texts(s, d).where("reference is not null and hypothesis is not null").select("result_id", M.word_errors(F.col("reference"), F.col("hypothesis")).alias("x"))
    k = F.col("x.distance").cast("bigint")
    return x.select("result_id", k.alias("distance"), F.col("x.ref_length").cast("bigint").alias("ref_length"), F.col("x.hyp_length").cast("bigint").alias("hyp_length"), F.round(M.rate(k, F.col("x.ref_length")), 6).alias("rate"))


_N2 = (words_sql("coalesce(reference, '')"), words_sql("coalesce(hypothesis, '')"))
_WER = f"CASE WHEN len(r) = 0 THEN CASE WHEN len(h) > 0 THEN 1.0 ELSE 0.0 END ELSE {distance_sql()} / len(r) END"


def _with_errors(rows):
    """Adds the errors ``x`` and the rate ``wer`` over the words of both texts; a missing text has no words."""
    w = lambda c: T.n2_words(F.coalesce(F.col(c), F.lit("")))
    x = rows.withColumn("x", M.aligned(w("reference"), w("hypothesis"), insertion_first=True))
    empty = F.when(F.col("x.hyp_length") > 0, 1.0).otherwise(0.0)
    return x.withColumn("wer", F.when(F.col("x.ref_length") == 0, empty).otherwise(F.col("x.distance") / F.col("x.ref_length")))


@query("m4_word_error_rate", f"WITH {TEXTS_SQL}, {paired_sql(*_N2)} SELECT result_id, len(r) AS ref_words, len(h) AS hyp_words, round(CAST({_WER} AS DOUBLE), 4) AS wer FROM c")
def _(s, d):
    x = _with_errors(texts(s, d))
    return x.select("result_id", F.col("x.ref_length").cast("bigint").alias("ref_words"), F.col("x.hyp_length").cast("bigint").alias("hyp_words"), F.round("wer", 4).alias("wer"))


def _rates(form):
    r, h = form(F.col("reference")), form(F.col("hypothesis"))
    return lambda s, d, **how: texts(s, d).where("reference is not null and hypothesis is not null").select("result_id", F.round(M.character_error_rate(r, h, **how), 4).alias("cer"))


def _rates_sql(form, empty, cap=False, length="len(r)"):
    value = f"{distance_sql()} / {length}"
    value = f"least({value}, 1.0)" if cap else value
    return f"WITH {TEXTS_SQL}, {paired_sql(split_sql(form('reference')), split_sql(form('hypothesis')))} SELECT result_id, round(CAST(CASE WHEN len(r) = 0 THEN {empty} ELSE {value} END AS DOUBLE), 4) AS cer FROM c WHERE reference IS NOT NULL AND hypothesis IS NOT NULL"


_BARE = lambda c: f"regexp_replace({c}, '\\s', '', 'g')"
_EITHER = "CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END"

query("m5_character_error_rate", _rates_sql(_BARE, _EITHER))(lambda s, d: _rates(T.n3)(s, d))
query("m6_capped_error_rate", _rates_sql(n5_sql, _EITHER, cap=True))(lambda s, d: _rates(T.n5)(s, d, capped=True))
query("m6_capped_zero_if_empty", _rates_sql(n4_sql, "0.0", cap=True))(lambda s, d: _rates(T.n4)(s, d, capped=True, empty="zero"))
query("m6_semantic_error_rate", _rates_sql(n6_sql, _EITHER, cap=True))(lambda s, d: _rates(T.n6)(s, d, capped=True))
_N8 = lambda c: f"translate(nfc_normalize({c}), ' ' || chr(10) || chr(9), '')"
query("m7_uncapped_error_rate", _rates_sql(_N8, _EITHER))(lambda s, d: _rates(T.n8)(s, d))
query("m7_at_least_one", _rates_sql(_N8, f"CAST({distance_sql()} AS DOUBLE)"))(lambda s, d: _rates(T.n8)(s, d, empty="one"))


@query("m14_confidence", "WITH seg AS (SELECT row_id, confidence - 1 AS logprob, \"end\" - start AS no_speech FROM transcribe_segments) SELECT row_id, coalesce(round(CASE WHEN no_speech > 0.5 THEN least(greatest(1 + logprob, 0), 1) * 0.5 ELSE least(greatest(1 + logprob, 0), 1) END, 3), 0.5) AS confidence FROM seg")
def _(s, d):
    return table(s, d, "transcribe_segments").select("row_id", M.segment_confidence(F.col("confidence") - 1, F.col("end") - F.col("start")).alias("confidence"))


# evaluations --------------------------------------------------------------


@query("h2_evaluation", f"WITH {TEXTS_SQL}, {paired_sql(*_N2)}, e AS (SELECT model_key, type, CAST({_WER} AS DOUBLE) AS wer, {distance_sql()} AS errors, len(r) AS words FROM c WHERE reference IS NOT NULL AND hypothesis IS NOT NULL) SELECT model_key, type, count(*) AS results, round(avg(wer) * 100, 2) AS macro_wer, round(sum(errors) / greatest(sum(words), 1) * 100, 2) AS weighted_wer FROM e GROUP BY model_key, type")
def _(s, d):
    """All types of a model at once: the mean rate of its results and the rate of all their words, in percent."""
    x = _with_errors(texts(s, d).where("reference is not null and hypothesis is not null"))
    weighted = F.sum("x.distance") / F.greatest(F.sum("x.ref_length"), F.lit(1))
    return x.groupBy("model_key", "type").agg(F.count("*").alias("results"), F.round(F.avg("wer") * 100, 2).alias("macro_wer"), F.round(weighted * 100, 2).alias("weighted_wer"))


@query("ag5_weighted_rate", f"WITH {TEXTS_SQL}, {paired_sql(*_N2)}, e AS (SELECT model_key, CAST({_WER} AS DOUBLE) AS wer, {distance_sql()} AS errors, len(r) AS words FROM c) SELECT model_key, count(*) AS results, round(avg(wer), 6) AS macro_wer, round(sum(errors) / greatest(sum(words), 1), 6) AS weighted_wer FROM e GROUP BY model_key")
def _(s, d):
    """Sum of all errors over all reference words of a model, beside the mean over its results; a missing text has no words."""
    x = _with_errors(texts(s, d))
    weighted = F.sum("x.distance") / F.greatest(F.sum("x.ref_length"), F.lit(1))
    return x.groupBy("model_key").agg(F.count("*").alias("results"), F.round(F.avg("wer"), 6).alias("macro_wer"), F.round(weighted, 6).alias("weighted_wer"))


@query("h3_worst_results", f"WITH {TEXTS_SQL}, {paired_sql(*_N2)}, e AS (SELECT *, CASE WHEN reference IS NULL OR hypothesis IS NULL THEN 1.0 ELSE CAST({_WER} AS DOUBLE) END AS rate FROM c WHERE reference IS DISTINCT FROM hypothesis) SELECT model_key, source, result_id, cer, reference, hypothesis, round(rate, 4) AS wer FROM e WHERE rate > 0.3")
def _(s, d):
    """All results whose texts differ by more than 0.3 of the reference's words; a missing text counts as all wrong."""
    cols = ["model_key", "source", "result_id", "cer", "reference", "hypothesis"]
    x = _with_errors(texts(s, d).select(*cols).where(~F.col("reference").eqNullSafe(F.col("hypothesis"))))
    wer = F.when(F.col("reference").isNull() | F.col("hypothesis").isNull(), 1.0).otherwise(F.col("wer"))
    return x.withColumn("wer", wer).where("wer > 0.3").withColumn("wer", F.round("wer", 4)).select(*cols, "wer")


def common_errors(rows, group, most):
    """Of each group the ``most`` frequent changed, dropped or added words; the one that occurs first of several."""
    x = rows.where("reference is not null and hypothesis is not null").select(group, "result_id", F.posexplode(M.word_errors(F.col("reference"), F.col("hypothesis"))["ops"]).alias("place", "o"))
    n = x.groupBy(group, "o.op", "o.ref", "o.hyp").agg(F.count("*").alias("n"), F.min(F.struct("result_id", "place")).alias("first"))
    rank = Window.partitionBy(group).orderBy(F.desc("n"), "first")
    return n.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most)


@query("ag8_common_errors")
def _(s, d):
    return common_errors(texts(s, d), "type", 20).select("type", "op", "ref", "hyp", "n", "place")


@query("ag9_common_errors_overall")
def _(s, d):
    """The fifteen most frequent errors by the sum of the lists of all types, which hold twenty each."""
    per = common_errors(texts(s, d), "type", 20)
    total = per.groupBy("op", "ref", "hyp").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return total.orderBy(F.desc("n"), "first").limit(15).select("op", "ref", "hyp", "n")


# runs against runs --------------------------------------------------------

_BEFORE_AFTER = "b AS (SELECT model_key, type, avg(cer) FILTER (run_id % 2 = 0) AS before, avg(cer) FILTER (run_id % 2 = 1) AS after FROM texts WHERE cer IS NOT NULL GROUP BY model_key, type)"


def _halves(s, d):
    """Mean rates of the runs with even numbers (the baseline) and of the others, by model and type."""
    x = texts(s, d).where("cer is not null").withColumn("after", F.col("run_id") % 2 == 1).groupBy("model_key", "type", "after").agg(F.avg("cer").alias("cer"))
    return x.where("not after").drop("after"), x.where("after").drop("after")


@query("j8_against_baseline", f"WITH {TEXTS_SQL}, {_BEFORE_AFTER} SELECT model_key, type, round(before, 4) AS before, round(after, 4) AS after, round(after - before, 4) AS diff, CASE WHEN round(after - before, 4) > 1 THEN 'worse' WHEN round(after - before, 4) < -1 THEN 'better' ELSE 'same' END AS status FROM b WHERE before IS NOT NULL AND after IS NOT NULL")
def _(s, d):
    x = J.against_baseline(*_halves(s, d), ["model_key", "type"], "cer", 1.0)
    return x.withColumn("before", F.round("before", 4)).withColumn("after", F.round("after", 4))


@query("m10_gate", f"WITH {TEXTS_SQL}, {_BEFORE_AFTER} SELECT model_key, CAST(count_if(round(after - before, 4) > 1) AS BIGINT) AS worse, CAST(count_if(round(after - before, 4) <= 1) AS BIGINT) AS others, count_if(round(after - before, 4) > 1) = 0 AS passed FROM b WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY model_key")
def _(s, d):
    """A model passes if none of its types got worse."""
    x = J.against_baseline(*_halves(s, d), ["model_key", "type"], "cer", 1.0)
    bad = F.col("status") == "worse"
    return x.groupBy("model_key").agg(F.count_if(bad).alias("worse"), F.count_if(~bad).alias("others"), F.bool_and(~bad).alias("passed"))


# language model -----------------------------------------------------------

_W = "list_filter(string_split(trim(regexp_replace({}, '\\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"
_LM = f"""{TEXTS_SQL}, h AS (SELECT result_id, run_id, type, hypothesis, {_W.format('hypothesis')} AS w FROM texts WHERE hypothesis IS NOT NULL), r AS (SELECT {_W.format('reference')} AS w FROM texts WHERE reference IS NOT NULL),
 one AS (SELECT a, count(*) AS na FROM (SELECT unnest(w) AS a FROM r) GROUP BY a), two AS (SELECT a, b, count(*) AS nab FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM r)) GROUP BY a, b),
 v AS (SELECT count(*) AS v FROM one), q AS (SELECT result_id, w[i] AS a, w[i + 1] AS b FROM (SELECT result_id, w, unnest(range(1, len(w))) AS i FROM h)),
 l AS (SELECT result_id, sum(CASE WHEN na IS NULL THEN ln(1 / (v + 1)) ELSE ln((coalesce(nab, 0) + 1) / (na + v)) END) AS l FROM q LEFT JOIN one USING (a) LEFT JOIN two USING (a, b), v GROUP BY result_id),
 lm AS (SELECT h.result_id, run_id, type, hypothesis, w, len(w) AS words, round(coalesce(l, 0.0) / greatest(len(w), 1), 6) AS score FROM h LEFT JOIN l USING (result_id))"""


@query("m16_bigram_scores", f"WITH {_LM} SELECT result_id, CAST(words AS INTEGER) AS words, score FROM lm")
def _(s, d):
    t = texts(s, d)
    return D.bigram_scores(t.select("result_id", F.col("hypothesis").alias("text")), t.select(F.col("reference").alias("text")), ["result_id"])


@query("s9_best_candidate", f"""WITH {_LM}, m AS (SELECT run_id, type, avg(length(hypothesis)) AS mean, count(*) AS candidates FROM lm GROUP BY run_id, type),
 z AS (SELECT lm.*, candidates, length(hypothesis) / greatest(mean, 1.0) AS ratio FROM lm JOIN m ON lm.run_id IS NOT DISTINCT FROM m.run_id AND lm.type IS NOT DISTINCT FROM m.type WHERE lm.run_id IS NOT NULL AND lm.type IS NOT NULL),
 y AS (SELECT run_id, type, candidates, result_id, hypothesis AS text, round(10 * score - CASE WHEN ratio < 0.5 OR ratio > 2 THEN 5.0 ELSE 0.0 END - CASE WHEN regexp_matches(hypothesis, '(\\d{{2,}}월부터\\.?\\s*){{3,}}') THEN 100.0 ELSE 0.0 END - CASE WHEN regexp_matches(hypothesis, '(\\d\\s+){{6,}}') THEN 50.0 ELSE 0.0 END - CASE WHEN words > 3 AND len(list_distinct(w)) < 0.3 * words THEN 20.0 ELSE 0.0 END, 6) AS score FROM z)
SELECT run_id, type, candidates, result_id, score, text FROM y QUALIFY row_number() OVER (PARTITION BY run_id, type ORDER BY score DESC, result_id) = 1""")
def _(s, d):
    t = texts(s, d)
    c = t.where("run_id is not null and type is not null").select("run_id", "type", "result_id", F.col("hypothesis").alias("text"))
    return D.best_candidates(c, t.select(F.col("reference").alias("text")), ["run_id", "type"], "result_id")

"""Queries of filters, aggregates, metrics, sorts and reports over runs, rules and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.functions import metrics as M
from turnmill.plans.sequences import SEGMENTS_SQL, segments
from turnmill.session import table


def rules(s, d):
    return table(s, d, "medical_dict_entries")


def _runs(s, d):
    cols = ["result_id", "run_id", "model_key", "type", "source", "cer", "ref_len", "hyp_len", "ratio", "duration_s", "elapsed_s", "truncated"]
    a, b = (table(s, d, f"{m}_result_no_prompt").select(*cols) for m in ("jangmin", "seastar105"))
    return a.unionByName(b)


RUNS_SQL = "runs AS (SELECT result_id, run_id, model_key, type, source, cer, ref_len, hyp_len, ratio, duration_s, elapsed_s, truncated FROM (FROM jangmin_result_no_prompt UNION ALL FROM seastar105_result_no_prompt))"

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# filters and projections -------------------------------------------------


@query("pf1_rule_search", "SELECT id, wrong, correct FROM medical_dict_entries WHERE enabled AND (contains(lower(wrong), '정') OR contains(lower(correct), '정') OR contains(lower(coalesce(notes, '')), '정'))")
def _(s, d):
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("정"))
    return rules(s, d).where(F.col("enabled") & (has(F.col("wrong")) | has(F.col("correct")) | has(F.col("notes")))).select("id", "wrong", "correct")


@query("pf2_rule_by_id", "SELECT id, wrong, correct, priority FROM medical_dict_entries WHERE id = 'e0005'")
def _(s, d):
    return rules(s, d).where("id = 'e0005'").select("id", "wrong", "correct", "priority")


@query("pf3_categories", "SELECT DISTINCT category FROM medical_dict_entries")
def _(s, d):
    return rules(s, d).select("category").distinct()


@query("pf4_api_rows", f"WITH {SEGMENTS_SQL} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS index, coalesce(nullif(speaker, ''), '?') AS role, text FROM seg")
def _(s, d):
    from turnmill.operators.sequences import batches

    return batches(segments(s, d), 1).select("file_id", F.col("place").alias("index"), F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?")).alias("role"), "text")


@query("pf5_diarizer_roles", f"WITH {SEGMENTS_SQL} SELECT file_id, seq, CASE upper(speaker) WHEN 'SPEAKER_00' THEN 'doctor' WHEN 'SPEAKER_01' THEN 'patient' ELSE '?' END AS role FROM seg")
def _(s, d):
    up = F.upper("speaker")
    return segments(s, d).select("file_id", "seq", F.when(up == "SPEAKER_00", "doctor").when(up == "SPEAKER_01", "patient").otherwise("?").alias("role"))


@query("pf6_hallucinations", f"WITH {SEGMENTS_SQL} SELECT file_id, seq FROM seg WHERE NOT (regexp_matches(text, '시청해|구독|자막') OR regexp_matches(text, '^(네[,. ]*)+$') OR regexp_matches(text, '[♪♫]'))")
def _(s, d):
    t = F.col("text")
    return segments(s, d).where(~(t.rlike("시청해|구독|자막") | t.rlike(r"^(네[,. ]*)+$") | t.rlike("[♪♫]"))).select("file_id", "seq")


@query("pf7_valid_segments", f"""WITH {SEGMENTS_SQL} SELECT file_id, seq FROM seg WHERE length(trim(text, ' ')) >= 2 AND NOT regexp_matches(trim(text, ' '), '^[\\s.,!?~…·-]+$') AND NOT regexp_matches(trim(text, ' '), '^(\\[filler\\]\\s*)+$')""")
def _(s, d):
    from turnmill.functions.text import valid_segment

    return segments(s, d).where(valid_segment(F.col("text"))).select("file_id", "seq")


@query("pf8_low_confidence", f"WITH {SEGMENTS_SQL} SELECT file_id, seq, confidence FROM seg WHERE nullif(confidence, 0) < 0.75 OR regexp_matches(text, '[A-Za-z]{{3,}}')")
def _(s, d):
    return segments(s, d).where((F.nullif("confidence", F.lit(0.0)) < 0.75) | F.col("text").rlike("[A-Za-z]{3,}")).select("file_id", "seq", "confidence")


@query("pf9_duration", f"""WITH {SEGMENTS_SQL} SELECT file_id, seq, least("end" - "start", 5.0) AS seconds FROM seg WHERE "end" - "start" >= 0.8""")
def _(s, d):
    return segments(s, d).where("`end` - `start` >= 0.8").select("file_id", "seq", F.least(F.col("end") - F.col("start"), F.lit(5.0)).alias("seconds"))


@query("pf11_confidence_levels", f"""WITH {SEGMENTS_SQL} SELECT CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level, count(*) AS segments FROM seg GROUP BY 1""")
def _(s, d):
    return segments(s, d).groupBy(M.confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("segments"))


@query("pf12_without_reference", "SELECT file_id, type_num FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM jangmin_result_no_prompt t WHERE t.type = r.type_num AND trim(t.reference, ' ') <> '')")
def _(s, d):
    """Recordings that no reference text belongs to, those of unknown type among them."""
    known = table(s, d, "jangmin_result_no_prompt").where("trim(reference) <> ''").select(F.col("type").alias("type_num")).distinct()
    return table(s, d, "recordings").select("file_id", "type_num").join(known, "type_num", "left_anti").select("file_id", "type_num")





@query("pf14_truncation_flag", f"WITH {RUNS_SQL} SELECT result_id, round(hyp_len / ref_len, 4) AS length_ratio, hyp_len / ref_len < 0.5 AND ref_len > 50 AS short FROM runs WHERE ref_len > 0 AND hyp_len IS NOT NULL")
def _(s, d):
    r = F.col("hyp_len") / F.col("ref_len")
    return _runs(s, d).where("ref_len > 0 and hyp_len is not null").select("result_id", F.round(r, 4).alias("length_ratio"), ((r < 0.5) & (F.col("ref_len") > 50)).alias("short"))


@query("pf15_audio_names", "SELECT file_id, regexp_matches(file_id || '.WAV', '(?i)\\.(wav|mp3|m4a|ogg|flac)$') AS audio FROM recordings")
def _(s, d):
    return table(s, d, "recordings").select("file_id", F.concat("file_id", F.lit(".WAV")).rlike(r"(?i)\.(wav|mp3|m4a|ogg|flac)$").alias("audio"))


# aggregates --------------------------------------------------------------


@query("ag1_rule_stats", "SELECT category, strategy, count(*) AS rules, count_if(enabled) AS enabled, count_if(NOT enabled) AS disabled FROM medical_dict_entries GROUP BY category, strategy")
def _(s, d):
    return rules(s, d).groupBy("category", "strategy").agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))


@query("ag3_learning_stats", "SELECT count(*) AS total, CAST(count_if(contains(notes, 'source=auto')) AS BIGINT) AS auto, CAST(count_if(contains(lower(notes), 'llm')) AS BIGINT) AS llm, CAST(count(*) - count_if(contains(notes, 'source=auto')) - count_if(contains(lower(notes), 'llm')) AS BIGINT) AS manual FROM medical_dict_entries")
def _(s, d):
    auto, llm = F.count_if(F.contains("notes", F.lit("source=auto"))), F.count_if(F.contains(F.lower("notes"), F.lit("llm")))
    return rules(s, d).agg(F.count("*").alias("total"), auto.alias("auto"), llm.alias("llm"), (F.count("*") - auto - llm).alias("manual"))



@query("ag4_macro_average", f"WITH {RUNS_SQL} SELECT model_key, round(avg(cer), 2) AS avg_cer, count(cer) AS evaluated, count(*) - count(cer) AS failed FROM runs GROUP BY model_key")
def _(s, d):
    return _runs(s, d).groupBy("model_key").agg(F.round(F.avg("cer"), 2).alias("avg_cer"), F.count("cer").alias("evaluated"), (F.count("*") - F.count("cer")).alias("failed"))


_GRADE = "CASE WHEN cer <= 10 THEN 'S' WHEN cer <= 20 THEN 'A' WHEN cer <= 35 THEN 'B' WHEN cer <= 50 THEN 'C' WHEN cer <= 70 THEN 'D' WHEN cer IS NOT NULL THEN 'F' END"


@query("ag6_grades", f"WITH {RUNS_SQL} SELECT model_key, {_GRADE} AS grade, count(*) AS results FROM runs GROUP BY 1, 2")
def _(s, d):
    return _runs(s, d).groupBy("model_key", M.grade(F.col("cer")).alias("grade")).agg(F.count("*").alias("results"))


@query("ag7_buckets", f"WITH {RUNS_SQL} SELECT run_id, model_key, CASE WHEN cer < 15 THEN 'GOOD' WHEN cer < 30 THEN 'FAIR' WHEN cer IS NOT NULL THEN 'POOR' END AS bucket, list_sort(list(DISTINCT type)) AS types FROM runs WHERE type IS NOT NULL GROUP BY 1, 2, 3")
def _(s, d):
    return _runs(s, d).where("type is not null").groupBy("run_id", "model_key", M.bucket(F.col("cer")).alias("bucket")).agg(F.array_sort(F.collect_set("type")).alias("types"))


@query("ag10_speaker_stats", f"""WITH {SEGMENTS_SQL} SELECT file_id, speaker, count(*) AS segments, sum(length(text)) AS characters, round(avg(length(text)), 4) AS avg_length,
 round(avg(CASE WHEN len(string_split(trim(text, ' '), ' ')) <= 2 THEN 1.0 ELSE 0.0 END), 4) AS short_share FROM seg WHERE text IS NOT NULL GROUP BY file_id, speaker""")
def _(s, d):
    t = segments(s, d).where("text is not null").withColumn("n", F.length("text"))
    short = F.when(F.size(F.split(F.trim("text"), " ")) <= 2, 1.0).otherwise(0.0)
    return t.groupBy("file_id", "speaker").agg(F.count("*").alias("segments"), F.sum("n").alias("characters"), F.round(F.avg("n"), 4).alias("avg_length"), F.round(F.avg(short), 4).alias("short_share"))


_SPECIALTY = {"heart": ["혈압", "심전도", "숨"], "digestion": ["복통", "위내시경", "설사"], "bone": ["무릎", "허리", "어깨"]}


@query(
    "ag13_specialty_scores",
    f"WITH {SEGMENTS_SQL}, h AS (SELECT file_id, "
    + ", ".join(f"({' + '.join(f'''max(CASE WHEN contains(text, '{k}') THEN 1 ELSE 0 END)''' for k in ks)}) / {len(ks)}.0 AS {n}" for n, ks in _SPECIALTY.items())
    + " FROM seg GROUP BY file_id), l AS (UNPIVOT h ON heart, digestion, bone INTO NAME specialty VALUE raw) SELECT file_id, specialty, round(raw / max(raw) OVER (PARTITION BY file_id), 4) AS score FROM l WHERE raw > 0",
)
def _(s, d):
    hit = lambda k: F.max(F.when(F.contains("text", F.lit(k)), 1).otherwise(0))
    per = segments(s, d).groupBy("file_id").agg(*[(sum((hit(k) for k in ks[1:]), hit(ks[0])) / float(len(ks))).alias(n) for n, ks in _SPECIALTY.items()])
    long = per.select("file_id", F.inline(F.array(*[F.struct(F.lit(n).alias("specialty"), F.col(n).alias("raw")) for n in _SPECIALTY])), F.greatest(*_SPECIALTY).alias("most")).where("raw > 0")
    return long.select("file_id", "specialty", F.round(F.col("raw") / F.col("most"), 4).alias("score"))


_NGRAM_SQL = """w AS (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM transcribe_segments WHERE text IS NOT NULL)"""


@query("ag15_unigrams", f"WITH {_NGRAM_SQL} SELECT unnest(w) AS w1, count(*) AS n FROM w GROUP BY 1")
def _(s, d):
    return _grams(s, d, 1)


@query("ag15_bigrams", f"WITH {_NGRAM_SQL}, g AS (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1) SELECT w[i] AS w1, w[i + 1] AS w2, count(*) AS n FROM g GROUP BY 1, 2")
def _(s, d):
    return _grams(s, d, 2)


@query("ag15_trigrams", f"WITH {_NGRAM_SQL}, g AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2) SELECT w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS n FROM g GROUP BY 1, 2, 3")
def _(s, d):
    return _grams(s, d, 3)


def _grams(s, d, k):
    w = table(s, d, "transcribe_segments").where("text is not null").select(F.filter(F.split("text", " "), lambda x: x != "").alias("w")).where(F.size("w") >= k)
    each = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.struct(*[F.element_at("w", i + j).alias(f"w{j + 1}") for j in range(k)]))
    return w.select(F.inline(each)).groupBy(*[f"w{j + 1}" for j in range(k)]).agg(F.count("*").alias("n"))


@query("ag16_latency", f"WITH {RUNS_SQL} SELECT type, source, min(elapsed_s) AS least, max(elapsed_s) AS most, round(avg(elapsed_s), 4) AS mean, round(sum(elapsed_s), 2) AS total FROM runs GROUP BY type, source")
def _(s, d):
    return _runs(s, d).groupBy("type", "source").agg(F.min("elapsed_s").alias("least"), F.max("elapsed_s").alias("most"), F.round(F.avg("elapsed_s"), 4).alias("mean"), F.round(F.sum("elapsed_s"), 2).alias("total"))


@query("ag19_best_run", f"WITH {RUNS_SQL} SELECT type, arg_min(result_id, (cer, result_id)) AS result_id, min(cer) AS cer FROM runs WHERE cer IS NOT NULL AND type IS NOT NULL GROUP BY type")
def _(s, d):
    best = F.min(F.struct("cer", "result_id"))
    return _runs(s, d).where("cer is not null and type is not null").groupBy("type").agg(best.alias("b")).select("type", F.col("b.result_id").alias("result_id"), F.col("b.cer").alias("cer"))


@query("ag20_viewer_totals", f"""WITH {SEGMENTS_SQL} SELECT count(*) AS segments, sum(length(text)) AS characters, count_if(confidence >= 0.8) AS high, count_if(confidence >= 0.5 AND confidence < 0.8) AS medium, count_if(confidence < 0.5) AS low FROM seg""")
def _(s, d):
    c = F.col("confidence")
    return segments(s, d).agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("characters"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


@query("ag23_model_wins", "SELECT model_key, sum(wins) AS wins, round(avg(avg_cer), 3) AS avg_cer, sum(truncated_types) AS truncated_types, count(*) AS runs FROM model_comparison_final GROUP BY model_key")
def _(s, d):
    return table(s, d, "model_comparison_final").groupBy("model_key").agg(F.sum("wins").alias("wins"), F.round(F.avg("avg_cer"), 3).alias("avg_cer"), F.sum("truncated_types").alias("truncated_types"), F.count("*").alias("runs"))


@query("ag24_distinct_words", "WITH w AS (SELECT result_id, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS w FROM seastar105_result_no_prompt WHERE hypothesis IS NOT NULL) SELECT result_id, len(w) AS words, len(list_distinct(w)) AS different, len(list_distinct(w)) / len(w) < 0.3 AS repetitive FROM w WHERE len(w) > 0")
def _(s, d):
    w = table(s, d, "seastar105_result_no_prompt").where("hypothesis is not null").select("result_id", F.filter(F.split("hypothesis", " "), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    return w.select("result_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("different"), (F.size(F.array_distinct("w")) / F.size("w") < 0.3).alias("repetitive"))


@query("ag25_real_time_factor", f"WITH {RUNS_SQL} SELECT model_key, round(sum(elapsed_s) / sum(duration_s), 4) AS factor FROM runs WHERE elapsed_s IS NOT NULL AND duration_s IS NOT NULL GROUP BY model_key")
def _(s, d):
    return _runs(s, d).where("elapsed_s is not null and duration_s is not null").groupBy("model_key").agg(F.round(F.sum("elapsed_s") / F.sum("duration_s"), 4).alias("factor"))


# metrics -----------------------------------------------------------------


def _texts(s, d):
    return table(s, d, "seastar105_result_no_prompt").where("reference is not null and hypothesis is not null")


@query("m9_improvement", "WITH a AS (SELECT type, avg(cer) AS b FROM jangmin_result_no_prompt GROUP BY type), c AS (SELECT type, avg(cer) AS a FROM seastar105_result_no_prompt GROUP BY type) SELECT type, round(CASE WHEN b > 0 THEN (b - a) / b * 100 ELSE 0.0 END, 2) AS improvement FROM a JOIN c USING (type)")
def _(s, d):
    a, b = (table(s, d, f"{m}_result_no_prompt").groupBy("type").agg(F.avg("cer").alias(n)) for m, n in (("jangmin", "b"), ("seastar105", "a")))
    return a.join(b, "type").select("type", F.round(M.improvement(F.col("b"), F.col("a")), 2).alias("improvement"))


@query("m10_regression_gate", """WITH r AS (SELECT run_id, model_key, avg_cer, lag(avg_cer) OVER (PARTITION BY model_key ORDER BY run_at, run_id) AS before FROM model_comparison_final)
SELECT run_id, model_key, CASE WHEN avg_cer - before > 2 THEN 'worse' WHEN avg_cer - before < -2 THEN 'better' ELSE 'same' END AS status FROM r WHERE before IS NOT NULL""")
def _(s, d):
    w = Window.partitionBy("model_key").orderBy("run_at", "run_id")
    diff = F.col("avg_cer") - F.lag("avg_cer").over(w)
    r = table(s, d, "model_comparison_final").select("run_id", "model_key", diff.alias("diff"), F.lag("avg_cer").over(w).alias("before"))
    return r.where("before is not null").select("run_id", "model_key", F.when(F.col("diff") > 2, "worse").when(F.col("diff") < -2, "better").otherwise("same").alias("status"))


# sorts and limits --------------------------------------------------------


@query("s3_longest_texts", f"WITH {SEGMENTS_SQL} SELECT file_id, speaker, seq, text FROM seg WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, speaker ORDER BY length(text) DESC, seq) <= 5")
def _(s, d):
    # five best of each block first, so a hot speaker isn't ranked in one task
    rows = segments(s, d).where("text is not null").withColumn("n", F.length("text")).withColumn("block", F.floor(F.col("seq") / 4096))
    order = [F.desc("n"), "seq"]
    near = Window.partitionBy("file_id", "speaker", "block").orderBy(*order)
    far = Window.partitionBy("file_id", "speaker").orderBy(*order)
    return rows.withColumn("k", F.row_number().over(near)).where("k <= 5").withColumn("k", F.row_number().over(far)).where("k <= 5").select("file_id", "speaker", "seq", "text")


@query("s1_rule_order", "SELECT id, row_number() OVER (ORDER BY priority DESC, length(wrong) DESC, id) AS place FROM medical_dict_entries WHERE enabled")
def _(s, d):
    return rules(s, d).where("enabled").select("id", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc(F.length("wrong")), "id")).alias("place"))


@query("s8_best_results", f"WITH {RUNS_SQL} SELECT model_key, result_id, cer FROM runs WHERE cer IS NOT NULL")
def _(s, d):
    return _runs(s, d).where("cer is not null").select("model_key", "result_id", "cer").orderBy("cer", "result_id")


# sources -----------------------------------------------------------------


@query("src5_types", "SELECT type_num, count(*) AS files, count_if(source = 'donkey') AS donkey, count_if(source = 'dalpha') AS dalpha, round(sum(duration_s), 3) AS seconds, max(max(type_num)) OVER () + 1 AS next_type FROM recordings WHERE type_num IS NOT NULL GROUP BY type_num HAVING count(DISTINCT source) = 2")
def _(s, d):
    """Types that both sources deliver, with their files and seconds, and the number that a new type would get."""
    r = table(s, d, "recordings").where("type_num is not null")
    n = r.groupBy("type_num").agg(F.count("*").alias("files"), F.count_if(F.col("source") == "donkey").alias("donkey"), F.count_if(F.col("source") == "dalpha").alias("dalpha"), F.round(F.sum("duration_s"), 3).alias("seconds"), F.count_distinct("source").alias("n"))
    return n.where("n = 2").drop("n").withColumn("next_type", n.where("n = 2").agg(F.max("type_num")).scalar() + 1)



@query("src6_union_scan", f"WITH {SEGMENTS_SQL} SELECT s.file_id, seq, type_num, r.source FROM seg s JOIN recordings r USING (file_id) WHERE trim(text, ' ') <> ''")
def _(s, d):
    return segments(s, d).where("trim(text) <> ''").join(table(s, d, "recordings").select("file_id", "type_num", "source"), "file_id").select("file_id", "seq", "type_num", "source")


@query("src11_hints", "SELECT DISTINCT category, unnest(context_hint) AS hint FROM medical_dict_entries")
def _(s, d):
    return rules(s, d).select("category", F.explode("context_hint").alias("hint")).distinct()


@query("src16_url_hints", "SELECT file_id, regexp_extract(u, '[^/]+$') AS name, TRY_CAST(nullif(regexp_extract(u, '(?i)type(\\d+)', 1), '') AS INTEGER) AS hint FROM (SELECT file_id, 'https://host.example/audio/Type' || coalesce(CAST(type_num AS VARCHAR), 'x') || '/' || file_id || '.wav' AS u FROM recordings)")
def _(s, d):
    u = F.concat(F.lit("https://host.example/audio/Type"), F.coalesce(F.col("type_num").cast("string"), F.lit("x")), F.lit("/"), "file_id", F.lit(".wav"))
    return table(s, d, "recordings").select("file_id", F.regexp_extract(u, "[^/]+$", 0).alias("name"), F.regexp_extract(u, r"(?i)type(\d+)", 1).try_cast("int").alias("hint"))


@query("src19_history", "SELECT run_id, model_key, avg_cer, run_at FROM model_comparison_final ORDER BY run_at DESC, run_id, model_key LIMIT 20")
def _(s, d):
    return table(s, d, "model_comparison_final").select("run_id", "model_key", "avg_cer", "run_at").orderBy(F.desc("run_at"), "run_id", "model_key").limit(20)


@query("src20_training_set", f"WITH {SEGMENTS_SQL} SELECT file_id, seq, left(text, 500) AS text, type_num FROM seg JOIN recordings USING (file_id) WHERE trim(text, ' ') <> ''")
def _(s, d):
    return segments(s, d).where("trim(text) <> ''").join(table(s, d, "recordings").select("file_id", "type_num"), "file_id").select("file_id", "seq", F.left("text", F.lit(500)).alias("text"), "type_num")

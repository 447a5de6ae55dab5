"""Queries of recovery, prompts, mentions, imports and models that are plugged in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.functions import metrics as M
from turnmill.functions import text as T
from turnmill.operators import recovery as V
from turnmill.operators import roles, rules
from turnmill.operators import sequences as S
from turnmill.plans import evaluation as E
from turnmill.plans import joined
from turnmill.plans.dialogue import _FOLD, _OVERLAP, _REPEAT
from turnmill.plans.sequences import SEGMENTS_SQL, segments
from turnmill.sources import dictionary
from turnmill.sources import transcripts as X
from turnmill.session import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# recovery: a stand-in hears one piece of speech in every gap of two seconds or more -------------------------------


def _hear(batches):
    for b in batches:
        d = b.to_pydict()
        at = [i for i in range(b.num_rows) if d["gap_end"][i] - d["gap_start"][i] >= 2.0]
        n = len(at)
        yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(at, pa.int64())), b.column("gap_start").take(pa.array(at, pa.int64())), pa.array([0.6] * n, pa.float64()), pa.array([1.4] * n, pa.float64()), pa.array([" 다시 들은 말 "] * n, pa.string())], ["file_id", "gap_start", "start", "end", "text"])


def _gaps(s, d):
    return S.time_gaps(segments(s, d), table(s, d, "recordings")).select("file_id", "gap_start", "gap_end").distinct()


_GAPS = f"""{SEGMENTS_SQL}, k AS (SELECT * FROM seg WHERE "start" IS NOT NULL AND "end" IS NOT NULL), g0 AS (SELECT file_id, lag("end") OVER w AS gap_start, "start" AS gap_end FROM k WINDOW w AS (PARTITION BY file_id ORDER BY "start", seq)),
 ends AS (SELECT file_id, min("start") AS first, last("end" ORDER BY "start", seq, "end") AS last FROM k GROUP BY file_id),
 gaps AS (SELECT DISTINCT * FROM (SELECT * FROM g0 WHERE gap_end - gap_start >= 1.0 UNION ALL SELECT file_id, 0.0, first FROM ends WHERE first > 1.0 UNION ALL SELECT file_id, last, duration_s FROM ends JOIN recordings USING (file_id) WHERE duration_s - last > 1.0)),
 heard AS (SELECT file_id, gap_start, CAST(round(CAST(0.6 + gap_start - least(0.5, gap_start) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS "start", CAST(round(CAST(1.4 + gap_start - least(0.5, gap_start) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS "end", '다시 들은 말' AS text FROM gaps WHERE gap_end - gap_start >= 2.0)"""


@query("h8_heard_in_gaps", f'WITH {_GAPS} SELECT file_id, gap_start, "start", "end", text FROM heard')
def _(s, d):
    return V.tried_again(_gaps(s, d), _hear)


@query("h9_recovery_counters", f"WITH {_GAPS}, n AS (SELECT g.file_id, g.gap_start, count(h.text) AS n FROM gaps g LEFT JOIN heard h ON g.file_id = h.file_id AND g.gap_start = h.gap_start GROUP BY ALL) SELECT g.file_id, count(*) AS gaps, count(*) FILTER (n.n > 0) AS recovered_gaps, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS recovered_segments FROM gaps g JOIN n ON g.file_id = n.file_id AND g.gap_start = n.gap_start GROUP BY g.file_id")
def _(s, d):
    gaps = _gaps(s, d)
    return V.counters(gaps, V.retranscribed(gaps, _hear))


_BOTH = f"""{_GAPS}, orig AS (SELECT * FROM seg), joined AS (SELECT file_id, CAST(seq AS INTEGER) AS seq, "start", "end", text FROM orig UNION ALL SELECT file_id, CAST(-row_number() OVER (PARTITION BY file_id ORDER BY "start", "end", text) AS INTEGER), "start", "end", text FROM heard)"""


@query("j17_recovered", _FOLD.format(seg=_BOTH, act=_OVERLAP).replace("FROM seg WHERE \"start\" IS NOT NULL AND \"end\" IS NOT NULL),\n step", "FROM joined WHERE \"start\" IS NOT NULL AND \"end\" IS NOT NULL),\n step").replace("text FROM seg WHERE \"start\" IS NULL", "text FROM joined WHERE \"start\" IS NULL"))
def _(s, d):
    """Segments and what was heard in the gaps, those that share their time once."""
    return V.merged(segments(s, d), V.retranscribed(_gaps(s, d), _hear))


_HEARD = f"""{SEGMENTS_SQL}, wn AS (SELECT *, unnest(generate_series(CAST(floor("start" / 60.0) AS BIGINT), CAST(floor(("end" + 2.0) / 60.0) AS BIGINT))) AS win FROM seg WHERE "start" IS NOT NULL AND "end" > "start"),
 hd AS (SELECT * FROM wn WHERE "end" > greatest(win * 60.0 - 2.0, 0) AND "start" < (win + 1) * 60.0 AND (win = 0 OR "end" > win * 60.0))"""


@query("st3_long_form", _FOLD.format(seg=_HEARD, act=_REPEAT).replace("FROM seg WHERE \"start\" IS NOT NULL AND \"end\" IS NOT NULL),\n step", "FROM hd),\n step").split("SELECT file_id, seq, \"start\", \"end\", text FROM seg")[0] + "SELECT DISTINCT h.file_id, h.seq, s.\"start\", s.\"end\", s.text FROM held h JOIN seg s ON h.file_id = s.file_id AND h.seq = s.seq")
def _(s, d):
    return V.long_form(segments(s, d))


_HALF = "CASE WHEN seq % 2 = 0 THEN left(text, CAST(ceil(length(text) * 0.6) AS INTEGER)) ELSE left(text, CAST(floor(length(text) * 0.3) AS INTEGER)) END"


@query("h7_retried", f"WITH {SEGMENTS_SQL}, a AS (SELECT *, {_HALF} AS again FROM seg), r AS (SELECT *, coalesce(nullif(confidence, 0) < 0.5 AND trim(again, ' ') <> '' AND length(trim(again, ' ')) >= length(coalesce(text, '')) * 0.5, false) AS retried FROM a) SELECT file_id, seq, CASE WHEN retried THEN trim(again, ' ') ELSE text END AS text, retried FROM r")
def _(s, d):
    n = F.length("text")
    again = F.when(F.col("seq") % 2 == 0, F.left("text", F.ceil(n * 0.6).cast("int"))).otherwise(F.left("text", F.floor(n * 0.3).cast("int")))
    return V.retried(segments(s, d), again).select("file_id", "seq", "text", "retried")


@query("h16_revised", f"WITH {SEGMENTS_SQL}, l AS (SELECT *, CASE WHEN confidence <= 0.45 THEN row_number() OVER (PARTITION BY file_id, confidence <= 0.45 ORDER BY seq) END AS place FROM seg), r AS (SELECT *, coalesce(place <= 15 AND trim(upper(text), ' ') <> '' AND upper(text) <> text, false) AS revised FROM l) SELECT file_id, seq, CASE WHEN revised THEN upper(text) ELSE text END AS text, revised FROM r")
def _(s, d):
    return V.revised(segments(s, d), F.upper("text")).select("file_id", "seq", "text", "revised")


@query("h6_supplements", f"""WITH {SEGMENTS_SQL} SELECT file_id, seq, text AS second_text, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\\s\\-]{{2,}}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS second_english FROM seg WHERE text IS NOT NULL AND (coalesce(nullif(confidence, 0), 1.0) < 0.75 OR regexp_matches(text, '[A-Za-z]{{3,}}')) AND "end" - "start" >= 0.8""")
def _(s, d):
    """Pieces long enough for a second recognition that are unsure or hold English, with the English heard in them."""
    x = segments(s, d).where("text is not null").where((F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)) < 0.75) | F.col("text").rlike("[A-Za-z]{3,}")).where(F.col("end") - F.col("start") >= 0.8)
    english = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z\s\-]{2,})"), 1), lambda e: F.trim(e)), lambda e: e != "")
    return x.select("file_id", "seq", F.col("text").alias("second_text"), english.alias("second_english"))


# prompts ------------------------------------------------------------------


@query("seq14_prompt_tail", f"""WITH {SEGMENTS_SQL}, c AS (SELECT file_id, floor("start" / 60.0) AS chunk, string_agg(trim(text, ' '), ' ' ORDER BY "start", seq) AS said FROM seg WHERE "start" IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1, 2)
SELECT file_id, CAST(chunk AS BIGINT) AS chunk, right(coalesce(string_agg(said, ' ') OVER (PARTITION BY file_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 400) AS tail FROM c""")
def _(s, d):
    return V.prompt_tails(segments(s, d))


@query("pf13_first_segments", f"WITH {SEGMENTS_SQL} SELECT file_id, seq, text FROM seg QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seq) <= 30")
def _(s, d):
    return S.batches(segments(s, d).select("file_id", "seq", "text"), 30).where("place <= 30").select("file_id", "seq", "text")


@query("s6_time_order", f"""WITH {SEGMENTS_SQL} SELECT file_id, seq, row_number() OVER (PARTITION BY file_id ORDER BY "start", seq) AS place FROM seg WHERE "start" IS NOT NULL""")
def _(s, d):
    from turnmill.operators import blocked

    rows = segments(s, d).where("`start` is not null").select("file_id", "seq", "start").withColumn("block", blocked.block_of(F.col("start"), 1800.0))
    return blocked.running_count(rows, ["file_id"], "block", ["start", "seq"], F.lit(True), "place").select("file_id", "seq", "place")


_TERMS = "voc AS (SELECT DISTINCT correct AS term FROM medical_dict_entries WHERE length(correct) >= 2)"


def _terms(s, d):
    return table(s, d, "medical_dict_entries").select(F.col("correct").alias("term"))


@query("s4_mentioned_terms", f"WITH {SEGMENTS_SQL}, {_TERMS}, m AS (SELECT file_id, term, min((seq, strpos(text, term))) AS first FROM seg, voc WHERE contains(text, term) GROUP BY ALL) SELECT file_id, term, CAST(row_number() OVER (PARTITION BY file_id ORDER BY first, term) AS INTEGER) AS place FROM m QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY first, term) <= 50")
def _(s, d):
    """Terms of the vocabulary by where they are first said in a file, fifty at most."""
    m = V.mentions(segments(s, d), _terms(s, d), ["file_id", "seq"]).groupBy("file_id", "term").agg(F.min(F.struct("seq", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("first", "term"))
    return m.withColumn("place", place).where("place <= 50").select("file_id", "term", "place")


@query("so6_longest_mention", f"WITH {E.TEXTS_SQL}, {_TERMS}, m AS (SELECT result_id, term FROM texts, voc WHERE contains(hypothesis, term)) SELECT result_id, term FROM m QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY length(term) DESC, term) = 1")
def _(s, d):
    m = V.mentions(E.texts(s, d), _terms(s, d), ["result_id"], "hypothesis")
    return m.groupBy("result_id").agg(F.min(F.struct(-F.length("term"), "term"))["term"].alias("term"))


_MEDICAL = ["[가-힣]+증", "[가-힣]+술", "[가-힣]+제", "[가-힣]+검사", "[가-힣]+치료", "[A-Za-z]{2,}"]
_FOUND = "list_distinct(" + " || ".join(f"regexp_extract_all(hypothesis, '{p}')" for p in _MEDICAL) + ")"


@query("s5_extracted_terms", f"WITH {E.TEXTS_SQL} SELECT result_id, list_slice(list_sort({_FOUND}), 1, 30) AS terms FROM texts WHERE hypothesis IS NOT NULL")
def _(s, d):
    found = F.concat(*[F.regexp_extract_all("hypothesis", F.lit(f"({p})"), 1) for p in _MEDICAL])
    return E.texts(s, d).where("hypothesis is not null").select("result_id", F.slice(F.array_sort(F.array_distinct(found)), 1, 30).alias("terms"))


_BASE_PROMPT = "의료 진료 상담 대화입니다. 의사와 환자가 대화합니다. "


@query("t28_prompts", f"WITH {E.TEXTS_SQL} SELECT result_id, left('{_BASE_PROMPT}' || array_to_string(list_slice(list_sort({_FOUND}), 1, 30), ', '), 500) AS prompt FROM texts WHERE hypothesis IS NOT NULL")
def _(s, d):
    """The base with the terms that a first pass found, thirty at most, within five hundred characters."""
    found = F.concat(*[F.regexp_extract_all("hypothesis", F.lit(f"({p})"), 1) for p in _MEDICAL])
    x = E.texts(s, d).where("hypothesis is not null").select("result_id", F.slice(F.array_sort(F.array_distinct(found)), 1, 30).alias("terms"))
    return x.select("result_id", F.left(F.concat(F.lit(_BASE_PROMPT), F.array_join("terms", ", ")), F.lit(500)).alias("prompt"))


@query("so3_ordered_union", "WITH a AS (SELECT category, list(wrong ORDER BY id) AS w, list(correct ORDER BY id) AS c FROM medical_dict_entries GROUP BY category), u AS (SELECT category, unnest(w || c) AS term, generate_subscripts(w || c, 1) AS i FROM a) SELECT category, list(term ORDER BY i) AS terms FROM (SELECT category, term, min(i) AS i FROM u WHERE term IS NOT NULL GROUP BY category, term) GROUP BY category")
def _(s, d):
    """Words and then terms of a category in their order, each once."""
    e = table(s, d, "medical_dict_entries").groupBy("category").agg(F.array_sort(F.collect_list(F.struct("id", "wrong", "correct"))).alias("e"))
    both = F.concat(F.transform("e", lambda x: x["wrong"]), F.transform("e", lambda x: x["correct"]))
    return e.select("category", F.array_distinct(F.array_compact(both)).alias("terms"))


# Words that tell a specialty, and which specialty the recordings of a type belong to (of this library).
SPECIALTY_WORDS = {
    "정형외과": ["관절", "골절", "디스크", "척추", "무릎", "허리", "인대", "연골", "수술"],
    "안과": ["백내장", "녹내장", "시력", "안약", "안압", "수정체", "망막"],
    "내분비내과": ["당뇨", "혈당", "인슐린", "갑상선", "호르몬", "코르티솔"],
    "간담도외과": ["담즙", "담관", "담석", "간", "낭종"],
    "소화기내과": ["내시경", "위", "대장", "용종", "역류"],
    "호흡기내과": ["흉부", "폐", "기침", "가래", "호흡", "천식"],
    "감염내과": ["열", "발열", "항생제", "감염", "권태감"],
    "비뇨기과": ["배뇨", "전립선", "방광", "신장", "요도"],
    "정신건강의학과": ["우울", "불안", "공황", "수면", "자살"],
    "신경과": ["두통", "어지럼", "뇌", "치매", "기억력"],
    "내과": ["혈압", "혈당", "콜레스테롤", "간기능"],
    "산부인과": ["자궁", "난소", "임신", "출산", "생리"],
}
TYPE_SPECIALTY = {1: "정형외과", 2: "안과", 3: "내분비내과", 4: "간담도외과", 5: "소화기내과", 6: "호흡기내과"}
_COUNTS = ", ".join("(" + " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in ws) + f") AS h{i}" for i, ws in enumerate(SPECIALTY_WORDS.values()))
_BEST = f"CASE greatest({', '.join(f'h{i}' for i in range(len(SPECIALTY_WORDS)))}) WHEN 0 THEN NULL " + " ".join(f"WHEN h{i} THEN '{k}'" for i, k in enumerate(SPECIALTY_WORDS)) + " END"


@query("ag14_specialty", f"WITH {E.TEXTS_SQL}, h AS (SELECT result_id, {_COUNTS} FROM (SELECT result_id, coalesce(reference, '') AS t FROM texts)) SELECT result_id, {_BEST} AS specialty FROM h")
def _(s, d):
    """The specialty with the most words in a reference, the first of several; null without any."""
    return E.texts(s, d).select("result_id", roles.best_of(F.col("reference"), SPECIALTY_WORDS).alias("specialty"))


_IN = lambda c: f"{c} IN ({', '.join(repr(k) for k in SPECIALTY_WORDS)})"
_TYPED = "CASE type_num " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TYPE_SPECIALTY.items()) + " END"
_PARTLY = "CASE " + " ".join(f"WHEN specialty <> '' AND (contains('{k}', specialty) OR contains(specialty, '{k}')) THEN '{k}'" for k in SPECIALTY_WORDS) + " END"


@query("t29_prompt_specialty", f"SELECT file_id, coalesce(CASE WHEN {_IN('specialty')} THEN specialty END, {_TYPED}, {_PARTLY}, 'universal') AS prompt FROM recordings")
def _(s, d):
    """Which prompt a recording gets: that of its specialty, of its type, of a specialty of which one name holds the other, or the universal one."""
    c = F.col("specialty")
    typed = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_SPECIALTY.items() for x in kv]), F.col("type_num"))
    partly = F.when(F.lit(False), c)
    for k in SPECIALTY_WORDS:
        partly = partly.when((c != "") & (F.lit(k).contains(c) | c.contains(k)), k)
    return table(s, d, "recordings").select("file_id", F.coalesce(F.when(c.isin(list(SPECIALTY_WORDS)), c), typed, partly, F.lit("universal")).alias("prompt"))


# statistics, searches -----------------------------------------------------


@query("ag2_engine_stats", "SELECT count(*) AS dict_total, CAST(count_if(enabled) AS BIGINT) AS dict_enabled, CAST(count_if(enabled AND strategy = 'exact') AS BIGINT) AS dict_exact, CAST(count_if(enabled AND strategy = 'regex') AS BIGINT) AS dict_regex, CAST(count_if(enabled AND strategy = 'phonetic') AS BIGINT) AS dict_phonetic, count(DISTINCT category) AS specialties, count(DISTINCT correct) AS terms, CAST(count_if(contains(notes, 'source=auto')) AS BIGINT) AS auto_learned FROM medical_dict_entries")
def _(s, d):
    on = F.col("enabled")
    kinds = [F.count_if(on & (F.col("strategy") == k)).alias(f"dict_{k}") for k in ("exact", "regex", "phonetic")]
    return table(s, d, "medical_dict_entries").agg(F.count("*").alias("dict_total"), F.count_if(on).alias("dict_enabled"), *kinds, F.count_distinct("category").alias("specialties"), F.count_distinct("correct").alias("terms"), F.count_if(F.contains("notes", F.lit("source=auto"))).alias("auto_learned"))


def _configs(form):
    return f"SELECT result_id, type, model_key, {form('reference')} AS rr, {form('hypothesis')} AS hh FROM texts WHERE reference IS NOT NULL AND hypothesis IS NOT NULL"


@query("h5_best_setting", f"""WITH {E.TEXTS_SQL}, u AS (SELECT *, 'plain' AS form FROM ({_configs(E.n5_sql)}) UNION ALL SELECT *, 'semantic' FROM ({_configs(E.n6_sql)})), p AS (SELECT *, {E.split_sql('rr')} AS r, {E.split_sql('hh')} AS h FROM u), c AS (SELECT *, {E.SHARED} FROM p),
 e AS (SELECT type, model_key, form, round(avg(CAST(CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE least({E.distance_sql()} / len(r), 1.0) END AS DOUBLE)), 6) AS cer FROM c GROUP BY type, model_key, form)
SELECT type, model_key, form, cer, cer > 0.05 AS second_pass FROM e QUALIFY row_number() OVER (PARTITION BY type ORDER BY cer, model_key, form) = 1""")
def _(s, d):
    """Of every type the model and normal form with the least mean rate, the first of several, and whether a second pass is due."""
    t = E.texts(s, d).where("reference is not null and hypothesis is not null")
    rates = F.array(*[F.struct(F.lit(k).alias("form"), M.character_error_rate(f(F.col("reference")), f(F.col("hypothesis")), capped=True).alias("cer")) for k, f in (("plain", T.n5), ("semantic", T.n6))])
    e = t.select("type", "model_key", F.inline(rates)).groupBy("type", "model_key", "form").agg(F.round(F.avg("cer"), 6).alias("cer"))
    best = e.groupBy("type").agg(F.min(F.struct("cer", "model_key", "form")).alias("b"))
    return best.select("type", "b.model_key", "b.form", "b.cer", (F.col("b.cer") > 0.05).alias("second_pass"))


# models and functions that are plugged in ---------------------------------


def _ask(batches):
    """A stand-in for a model: the longer texts are the doctor's."""
    for b in batches:
        n = [None if t is None else len(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("seq"), pa.array([None if x is None else "doctor" if x >= 20 else "patient" for x in n], pa.string())], ["file_id", "seq", "model_role"])


@query("r8_model_roles", f"WITH {SEGMENTS_SQL} SELECT file_id, seq, CASE WHEN text IS NULL THEN NULL WHEN length(text) >= 20 THEN 'doctor' ELSE 'patient' END AS model_role FROM seg")
def _(s, d):
    return roles.model_roles(segments(s, d).withColumn("role", roles.known_role(F.col("speaker"))), _ask)


def _fails(text: str) -> str:
    if "검사" in text:
        raise ValueError(text)
    return text.upper()


@query("h18_safe_correction", f"WITH {E.TEXTS_SQL} SELECT result_id, CASE WHEN contains(hypothesis, '검사') THEN hypothesis ELSE upper(hypothesis) END AS text FROM texts")
def _(s, d):
    """A function that fails on some texts leaves these as they are."""
    from turnmill.functions.cleaning import _texts

    return E.texts(s, d).select("result_id", _texts(rules.safely(_fails))(F.col("hypothesis")).alias("text"))


# sources ------------------------------------------------------------------


@query("src3_ground_truth", "SELECT DISTINCT r.type_num, t.text, t.text IS NULL AS missing FROM (SELECT DISTINCT type_num FROM recordings WHERE type_num IS NOT NULL) r LEFT JOIN (SELECT type, regexp_replace(regexp_replace(arg_min(reference, result_id), '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS text FROM jangmin_result_no_prompt WHERE reference IS NOT NULL GROUP BY type) t ON r.type_num = t.type")
def _(s, d):
    """The reference text of every type of recording, trimmed; types without one are marked."""
    ref = table(s, d, "jangmin_result_no_prompt").where("reference is not null").groupBy(F.col("type").alias("type_num")).agg(X.stripped(F.min_by("reference", "result_id")).alias("text"))
    types = table(s, d, "recordings").where("type_num is not null").select("type_num").distinct()
    return types.join(ref, "type_num", "left").withColumn("missing", F.col("text").isNull())


@query("src4_answers", """WITH d AS (SELECT doc_id, CASE WHEN contains(text, ']') AND regexp_matches(text, '^\\s*\\[') THEN left(text, length(text) - strpos(reverse(text), ']') + 1) END AS a FROM documents), j AS (SELECT doc_id, CASE WHEN json_valid(a) THEN from_json(a, '[{"content":"VARCHAR"}]') END AS t FROM d)
SELECT doc_id, array_to_string(list_transform(t, lambda x: coalesce(x.content, '')), ' ') AS text FROM j WHERE t IS NOT NULL""")
def _(s, d):
    return X.answers(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("src9_imported_rules", "SELECT wrong, correct, count(*) AS rules FROM (SELECT wrong, correct FROM medical_dict_entries UNION ALL SELECT correct, wrong FROM medical_dict_entries) GROUP BY wrong, correct")
def _(s, d):
    """Rules with a bulk of others, the same turned round; nothing is made distinct."""
    e = table(s, d, "medical_dict_entries")
    new = e.select(F.col("correct").alias("wrong"), F.col("wrong").alias("correct"), "category")
    return dictionary.imported(e, new).groupBy("wrong", "correct").agg(F.count("*").alias("rules"))


@query("src10_seeds", "SELECT wrong, correct, category, 60 + length(wrong) AS priority FROM (VALUES ('관절념', '관절염', '정형외과'), ('고관질', '고관절', '정형외과'), ('스테로에즈', '스테로이드', '정형외과'), ('릴리카', '리리카', '정형외과'), ('액저리', '엑스레이', '정형외과')) v(wrong, correct, category)")
def _(s, d):
    pairs = [("관절념", "관절염"), ("고관질", "고관절"), ("스테로에즈", "스테로이드"), ("릴리카", "리리카"), ("액저리", "엑스레이")]
    return dictionary.seeded(s, pairs, "정형외과").select("wrong", "correct", "category", F.col("priority").cast("bigint").alias("priority"))


@query("src11_vocabulary", "SELECT DISTINCT category AS specialty, correct AS term FROM medical_dict_entries WHERE correct IS NOT NULL AND category IS NOT NULL")
def _(s, d):
    """A document with a map of specialties, each with its terms, flattened."""
    e = table(s, d, "medical_dict_entries").where("correct is not null and category is not null").groupBy("category").agg(F.collect_set("correct").alias("terms"), F.collect_set("wrong").alias("keywords"))
    doc = e.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("category", F.struct("terms", "keywords")))).alias("specialties"))).alias("raw"))
    return dictionary.vocabulary(doc, "raw")


@query("src18_connector_segments", f"""WITH {SEGMENTS_SQL} SELECT file_id, round("start", 3) AS "start", round("end", 3) AS "end", text, confidence, count(*) AS n FROM seg WHERE regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', '', 'g') <> '' AND "start" IS NOT NULL AND "end" IS NOT NULL GROUP BY ALL""")
def _(s, d):
    """Responses of a recogniser in milliseconds, one a file, parsed into segments in seconds; empty texts are dropped."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    part = F.struct(ms("start").alias("start"), ms("end").alias("end"), "text", "confidence", F.struct(F.lit("1").alias("label")).alias("speaker"))
    raw = segments(s, d).where("`start` is not null and `end` is not null").groupBy("file_id", F.floor(F.col("seq") / 500).alias("part")).agg(F.to_json(F.struct(F.collect_list(part).alias("segments"))).alias("raw"))
    x = X.connector_segments(raw, ["file_id"], "raw")
    return x.groupBy("file_id", "start", "end", "text", "confidence").agg(F.count("*").alias("n"))


joined(QUERIES, ORACLES, "h6_supplements", "second_english")
joined(QUERIES, ORACLES, "s5_extracted_terms", "terms")
joined(QUERIES, ORACLES, "so3_ordered_union", "terms")

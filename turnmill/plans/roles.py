"""Queries of role evidence, role decisions, reviews and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.plans import joined
from turnmill.operators import roles
from turnmill.operators import sequences as S
from turnmill.plans.sequences import SEGMENTS_SQL, segments
from turnmill.session import cut_lineage

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rows(s, d):
    """Segments with the role that their speaker label names, if any."""
    return segments(s, d).withColumn("role", roles.known_role(F.col("speaker")))


# the same in SQL ----------------------------------------------------------

_T = "coalesce(text, '')"


def _has(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _weights(signs):
    return "round(" + " + ".join(f"CASE WHEN regexp_matches({_T}, '{p}') THEN {float(w)} ELSE 0.0 END" for p, w in signs) + ", 4)"


def _predicted(d, p):
    return f"CASE WHEN abs({d} - {p}) < 0.3 - 1e-9 THEN NULL WHEN {d} > {p} THEN 'doctor' ELSE 'patient' END"


def _sure(d, p):
    return f"CASE WHEN {d} + {p} > 0 THEN round(abs({d} - {p}) / ({d} + {p}), 4) ELSE 0.0 END"


_LABEL = "lower(coalesce(speaker, ''))"
_TYPE = f"CASE WHEN {_has(_LABEL, roles.ROLE_MARKS['doctor'])} THEN 'doctor' WHEN {_has(_LABEL, roles.ROLE_MARKS['patient'])} THEN 'patient' ELSE 'unknown' END"
_LONG = f"CASE WHEN length({_T}) > {roles.LONG_TEXT[0]} AND len(regexp_extract_all({_T}, '{roles.TERMS}')) >= {roles.LONG_TEXT[1]} THEN {roles.LONG_TEXT[2]} ELSE 0.0 END"
_BASE = f"{SEGMENTS_SQL}, base AS (SELECT *, {_TYPE} AS role_type, nullif({_TYPE}, 'unknown') AS role FROM seg)"
_DETAILS = f"""{_BASE}, det AS (SELECT *, CAST({_weights(roles.DOCTOR_ADDRESS)} AS DOUBLE) AS address_doctor, CAST({_weights(roles.PATIENT_ADDRESS)} AS DOUBLE) AS address_patient,
 CAST(round({_weights(roles.DOCTOR_SIGNS)} + {_LONG}, 4) AS DOUBLE) AS content_doctor, CAST({_weights(roles.PATIENT_SIGNS)} AS DOUBLE) AS content_patient, length({_T}) AS length FROM base)"""
_OWN = f"""{_DETAILS}, sc AS (SELECT *, round(address_doctor + content_doctor * 0.8, 4) AS d0, round(address_patient + content_patient * 0.8, 4) AS p0 FROM det),
 own AS (SELECT *, {_predicted('d0', 'p0')} AS own_role, CAST({_sure('d0', 'p0')} AS DOUBLE) AS own_confidence, regexp_matches({_T}, '{roles.QUESTION}') AS asks FROM sc)"""
_KNOWN = lambda i: f"coalesce(lag(own_role, {i}) OVER w, lag(role, {i}) OVER w)"
_HITS = ", ".join("(" + " + ".join(f"CASE WHEN contains({_T}, '{w}') THEN 1 ELSE 0 END" for w in ws) + f") AS hits_{k}" for k, ws in roles.PHASES.items())
_BEST = "CASE greatest(" + ", ".join(f"hits_{k}" for k in roles.PHASES) + ") WHEN 0 THEN NULL " + " ".join(f"WHEN hits_{k} THEN '{k}'" for k in roles.PHASES) + " END"


def _context(me, other):
    return f"""CAST(round(CASE WHEN asked AND before = '{other}' THEN 0.6 WHEN asked AND before IS NULL AND given = '{other}' THEN 0.4 ELSE 0.0 END + CASE WHEN asks AND after = '{other}' THEN 0.4 ELSE 0.0 END
 + CASE WHEN e1 = e2 AND e2 = e3 AND e1 = '{me}' THEN 0.45 ELSE 0.0 END
 + CASE WHEN NOT coalesce(CASE WHEN e1 IS NOT NULL THEN e1 = e2 WHEN e2 IS NOT NULL THEN e2 = e3 END, false) AND given = '{other}' THEN 0.2 ELSE 0.0 END, 4) AS DOUBLE)"""


_NEAR = f"""{_OWN}, near AS (SELECT *, coalesce(lag(asks) OVER w, false) AS asked, lag(own_role) OVER w AS before, lag(role) OVER w AS given, lead(own_role) OVER w AS after, {_KNOWN(1)} AS e1, {_KNOWN(2)} AS e2, {_KNOWN(3)} AS e3 FROM own WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
 ctx AS (SELECT *, {_context('doctor', 'patient')} AS context_doctor, {_context('patient', 'doctor')} AS context_patient FROM near)"""
_PHASES = f"""hit AS (SELECT *, {_HITS} FROM {{0}}), found AS (SELECT *, {_BEST} AS found FROM hit),
 filled AS (SELECT *, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(found IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS phase FROM found),
 flow AS (SELECT *, coalesce(lag(phase) OVER (PARTITION BY file_id ORDER BY seq) <> phase, false) AS phase_changed, CASE WHEN phase IN ('diagnosis', 'treatment') THEN 0.4 ELSE 0.0 END AS flow_doctor, CASE WHEN phase = 'complaint' THEN 0.4 ELSE 0.0 END AS flow_patient FROM filled)"""
_FULL = f"""{_NEAR}, {_PHASES.format('ctx')}, f0 AS (SELECT *, round(round(d0 + context_doctor * 0.5, 4) + flow_doctor * 0.3, 4) AS doctor_score, round(round(p0 + context_patient * 0.5, 4) + flow_patient * 0.3, 4) AS patient_score FROM flow),
 full_ AS (SELECT *, {_predicted('doctor_score', 'patient_score')} AS predicted_role, CAST({_sure('doctor_score', 'patient_score')} AS DOUBLE) AS role_confidence, d0 + p0 > 0 AS has_signal FROM f0),
 cor AS (SELECT *, CASE WHEN predicted_role IS NOT NULL AND predicted_role IS DISTINCT FROM role AND role_confidence >= 0.3 THEN predicted_role ELSE role END AS new_role FROM full_)"""


# evidence -----------------------------------------------------------------


@query("r1_address_evidence", f"WITH {_DETAILS} SELECT file_id, seq, address_doctor, address_patient FROM det")
def _(s, d):
    return roles.details(segments(s, d)).select("file_id", "seq", "address_doctor", "address_patient")


@query("r2_content_evidence", f"WITH {_DETAILS} SELECT file_id, seq, content_doctor, content_patient FROM det")
def _(s, d):
    return roles.details(segments(s, d)).select("file_id", "seq", "content_doctor", "content_patient")


@query("h12_signal_details", f"WITH {_DETAILS} SELECT file_id, seq, address_doctor, address_patient, content_doctor, content_patient, length, list_filter([{', '.join(f'''CASE WHEN regexp_matches({_T}, '{p}') THEN '{p}' END''' for p, _ in roles.DOCTOR_ADDRESS)}], lambda x: x IS NOT NULL) AS signs FROM det")
def _(s, d):
    x = roles.details(segments(s, d)).withColumn("signs", roles.signals(F.col("text"), roles.DOCTOR_ADDRESS)).withColumn("length", F.col("length").cast("bigint"))
    return x.select("file_id", "seq", "address_doctor", "address_patient", "content_doctor", "content_patient", "length", "signs")


@query("r3_predicted_role", f"WITH {_OWN} SELECT file_id, seq, d0 AS doctor_score, p0 AS patient_score, own_role AS predicted_role, own_confidence AS role_confidence FROM own")
def _(s, d):
    return roles.scored(segments(s, d)).select("file_id", "seq", "doctor_score", "patient_score", "predicted_role", "role_confidence")


@query("r4_phases", f"WITH {_BASE}, {_PHASES.format('base')} SELECT file_id, seq, found AS phase FROM flow")
def _(s, d):
    return segments(s, d).select("file_id", "seq", roles.best_of(F.col("text"), roles.PHASES).alias("phase"))


@query("seq9_context", f"WITH {_NEAR} SELECT file_id, seq, context_doctor, context_patient FROM ctx")
def _(s, d):
    return roles.with_context(roles.scored(rows(s, d))).select("file_id", "seq", "context_doctor", "context_patient")


@query("seq10_flow", f"WITH {_BASE}, {_PHASES.format('base')} SELECT file_id, seq, phase, phase_changed, CAST(flow_doctor AS DOUBLE) AS flow_doctor, CAST(flow_patient AS DOUBLE) AS flow_patient FROM flow")
def _(s, d):
    return roles.with_flow(segments(s, d)).select("file_id", "seq", "phase", "phase_changed", "flow_doctor", "flow_patient")


@query("r5_full_analysis", f"WITH {_FULL} SELECT file_id, seq, role, doctor_score, patient_score, predicted_role, role_confidence, CASE WHEN role_confidence >= 0.8 THEN 'high' WHEN role_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level, phase FROM full_")
def _(s, d):
    from turnmill.functions.metrics import confidence_level

    x = roles.analysed(rows(s, d))
    return x.select("file_id", "seq", "role", "doctor_score", "patient_score", "predicted_role", "role_confidence", confidence_level(F.col("role_confidence")).alias("level"), "phase")


def _corrected(s, d):
    x = cut_lineage(roles.analysed(rows(s, d)))
    return x.withColumn("new_role", roles.corrected(F.col("role"), F.col("predicted_role"), F.col("role_confidence")))


@query("r6_corrected_roles", f"WITH {_FULL} SELECT file_id, seq, role, new_role FROM cor")
def _(s, d):
    return _corrected(s, d).select("file_id", "seq", "role", "new_role")


@query("h13_changed_roles", f"WITH {_FULL} SELECT file_id, seq, role, new_role, role_confidence FROM cor WHERE new_role IS DISTINCT FROM role")
def _(s, d):
    return _corrected(s, d).where(~F.col("new_role").eqNullSafe(F.col("role"))).select("file_id", "seq", "role", "new_role", "role_confidence")


# reviews ------------------------------------------------------------------

_RUNS = """fr AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR {0} IS DISTINCT FROM lag({0}) OVER w THEN 1 ELSE 0 END AS fresh FROM {1} WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
 num AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM fr), run AS (SELECT *, count(*) OVER (PARTITION BY file_id, run) AS run_length FROM num)"""
_REVIEW = f"""{_FULL}, {_RUNS.format('new_role', 'cor')}, per AS (SELECT file_id, count(*) AS segments, round(count(*) FILTER (new_role = 'doctor') / count(*), 4) AS doctors, max(run_length) AS longest, round(count(*) FILTER (NOT has_signal) / count(*), 4) AS silent, round(count(*) FILTER (has_signal AND own_confidence < 0.5) / count(*), 4) AS unsure FROM run GROUP BY file_id),
 reason AS (SELECT *, list_filter([CASE WHEN doctors IN (0, 1) THEN 'single' WHEN doctors < 0.25 OR doctors > 0.75 THEN 'imbalanced' END, CASE WHEN longest >= 5 THEN 'long run' WHEN longest >= 3 THEN 'run' END, CASE WHEN silent > 0.6 THEN 'no signals' END, CASE WHEN unsure > 0.4 THEN 'unsure' END], lambda x: x IS NOT NULL) AS reasons FROM per),
 scope AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'none' WHEN doctors < 0.25 OR doctors > 0.75 THEN 'full' WHEN longest >= 3 THEN 'partial' WHEN silent > 0.6 THEN 'full' WHEN unsure > 0 THEN 'partial' ELSE 'none' END AS scope FROM reason)"""


def _review(s, d):
    """Corrected rows with their runs, and what each file needs: no, partial or full review, with the reasons."""
    x = cut_lineage(S.with_runs(_corrected(s, d).drop("text"), "new_role"))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    per = x.groupBy("file_id").agg(
        F.count("*").alias("segments"),
        share(F.col("new_role") == "doctor").alias("doctors"),
        F.max("run_length").alias("longest"),
        share(~F.col("has_signal")).alias("silent"),
        share(F.col("has_signal") & (F.col("own_confidence") < 0.5)).alias("unsure"),
    )
    c = F.col
    uneven = (c("doctors") < 0.25) | (c("doctors") > 0.75)
    reasons = F.array_compact(
        F.array(
            F.when(c("doctors").isin(0.0, 1.0), "single").when(uneven, "imbalanced"),
            F.when(c("longest") >= 5, "long run").when(c("longest") >= 3, "run"),
            F.when(c("silent") > 0.6, "no signals"),
            F.when(c("unsure") > 0.4, "unsure"),
        )
    )
    per = per.withColumn("reasons", reasons)
    scope = F.when(F.size("reasons") == 0, "none").when(uneven, "full").when(c("longest") >= 3, "partial").when(c("silent") > 0.6, "full").when(c("unsure") > 0, "partial").otherwise("none")
    return x, per.withColumn("scope", scope)


@query("r7_review_scope", f"WITH {_REVIEW} SELECT * FROM scope")
def _(s, d):
    return _review(s, d)[1]


@query("r7_review_rows", f"""WITH {_REVIEW}, m AS (SELECT r.file_id, r.seq, scope, longest, has_signal AND own_confidence < 0.5 AS low, max(CASE WHEN run_length >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY r.file_id ORDER BY r.seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM run r JOIN scope USING (file_id))
SELECT file_id, seq FROM m WHERE scope = 'full' OR (scope = 'partial' AND CASE WHEN longest >= 3 THEN near = 1 ELSE low END)""")
def _(s, d):
    """The rows to be looked at: all of a file, those up to two places from a run of three, or the unsure ones."""
    x, per = _review(s, d)
    x = S.spread(x.select("file_id", "seq", "run_length", (F.col("has_signal") & (F.col("own_confidence") < 0.5)).alias("low")), F.col("run_length") >= 3)
    x = x.join(per.select("file_id", "longest", "scope"), "file_id")
    part = F.when(F.col("longest") >= 3, F.col("marked")).otherwise(F.col("low"))
    return x.where((F.col("scope") == "full") | ((F.col("scope") == "partial") & part)).select("file_id", "seq")


@query("ag11_role_share", f"WITH {_REVIEW} SELECT file_id, segments, doctors, doctors IN (0, 1) AS single, doctors < 0.25 OR doctors > 0.75 AS imbalanced, silent, unsure FROM per")
def _(s, d):
    c = F.col
    return _review(s, d)[1].select("file_id", "segments", "doctors", c("doctors").isin(0.0, 1.0).alias("single"), ((c("doctors") < 0.25) | (c("doctors") > 0.75)).alias("imbalanced"), "silent", "unsure")


@query("ag18_run_lengths", f"WITH {_BASE}, {_RUNS.format('role', 'base')} SELECT run_length, count(*) AS segments, count(DISTINCT (file_id, run)) AS runs FROM run GROUP BY run_length")
def _(s, d):
    x = S.with_runs(rows(s, d), "role")
    return x.groupBy("run_length").agg(F.count("*").alias("segments"), F.count_distinct("file_id", "run").alias("runs"))


_BIN = "CASE WHEN length < 5 THEN '0-5' WHEN length < 15 THEN '5-15' WHEN length < 40 THEN '15-40' WHEN length < 80 THEN '40-80' ELSE '80-' END"


@query("ag18_length_bins", f"WITH {_OWN} SELECT {_BIN} AS bin, count(*) AS segments, count(*) FILTER (d0 + p0 = 0) AS silent FROM own GROUP BY 1")
def _(s, d):
    n = F.length(F.coalesce("text", F.lit("")))
    bin_ = F.when(n < 5, "0-5").when(n < 15, "5-15").when(n < 40, "15-40").when(n < 80, "40-80").otherwise("80-")
    return roles.scored(segments(s, d)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("segments"), F.count_if(F.col("doctor_score") + F.col("patient_score") == 0).alias("silent"))


#: Criteria for a review, as conditions on a row's silence, its run and its file's share of the doctor.
CRITERIA = {
    "silent": "silent",
    "runs of 3": "run_length >= 3",
    "runs of 5": "run_length >= 5",
    "uneven file": "(share < 0.2 OR share > 0.8)",
    "silent in runs of 3": "silent AND run_length >= 3",
    "silent or runs of 5": "silent OR run_length >= 5",
    "uneven file or silent in runs of 3": "share < 0.2 OR share > 0.8 OR (silent AND run_length >= 3)",
    "imbalanced file": "(share < 0.25 OR share > 0.75)",
    "imbalanced or single": "share IN (0, 1) OR share < 0.25 OR share > 0.75",
}


@query("u4_review_criteria", f"""WITH {_OWN}, {_RUNS.format('role', 'own')}, x AS (SELECT file_id, run_length, d0 + p0 = 0 AS silent, avg(CASE WHEN role = 'doctor' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY file_id) AS share FROM run)
""" + " UNION ALL ".join(f"SELECT '{k}' AS criterion, count(*) AS segments, count(DISTINCT file_id) AS files FROM x WHERE {v}" for k, v in CRITERIA.items()))
def _(s, d):
    """How many rows and files each criterion would send to a review."""
    x = S.with_runs(roles.scored(rows(s, d)), "role").withColumn("silent", F.col("doctor_score") + F.col("patient_score") == 0)
    share = x.groupBy("file_id").agg(F.avg(F.when(F.col("role") == "doctor", 1.0).otherwise(0.0)).alias("share"))
    hit = F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in CRITERIA.items()]))
    return x.join(share, "file_id").select("file_id", F.explode(hit).alias("criterion")).groupBy("criterion").agg(F.count("*").alias("segments"), F.count_distinct("file_id").alias("files"))


_QUALITY = "CASE WHEN new_role = 'doctor' THEN lead ELSE -lead END"


def _quality(s, d):
    x = roles.details(_corrected(s, d)).where("new_role is distinct from role")
    lead = F.round(F.col("address_doctor") + F.col("content_doctor") - F.col("address_patient") - F.col("content_patient"), 4)
    return x.withColumn("gain", F.when(F.col("new_role") == "doctor", lead).otherwise(-lead))


_GAIN = f"{_FULL}, g AS (SELECT *, CASE WHEN new_role = 'doctor' THEN 1 ELSE -1 END * round(address_doctor + content_doctor - address_patient - content_patient, 4) AS gain FROM cor WHERE new_role IS DISTINCT FROM role)"


@query("r10_correction_quality", f"WITH {_GAIN} SELECT file_id, count(*) AS changed, count(*) FILTER (gain > 0) AS improved, count(*) FILTER (gain < 0) AS worsened, count(*) FILTER (gain = 0) AS neutral, round(count(*) FILTER (gain > 0) / count(*), 4) AS accuracy FROM g GROUP BY file_id")
def _(s, d):
    g = F.col("gain")
    return _quality(s, d).groupBy("file_id").agg(F.count("*").alias("changed"), F.count_if(g > 0).alias("improved"), F.count_if(g < 0).alias("worsened"), F.count_if(g == 0).alias("neutral"), F.round(F.count_if(g > 0) / F.count("*"), 4).alias("accuracy"))


_STRATEGIES = f"""{_GAIN}, st AS (SELECT 'full' AS strategy, gain FROM g UNION ALL SELECT 'own', CASE WHEN own_role = 'doctor' THEN 1 ELSE -1 END * round(address_doctor + content_doctor - address_patient - content_patient, 4) FROM cor WHERE own_role IS NOT NULL AND own_role IS DISTINCT FROM role AND own_confidence >= 0.3),
 sum_ AS (SELECT strategy, count(*) AS changed, count(*) FILTER (gain > 0) AS improved, count(*) FILTER (gain < 0) AS worsened, count(*) FILTER (gain = 0) AS neutral FROM st GROUP BY strategy), net AS (SELECT *, improved - worsened AS net, round(improved / changed, 4) AS accuracy FROM sum_)"""


@query("ag17_strategy_scores", f"WITH {_STRATEGIES} SELECT *, round(net + 10 * accuracy, 4) AS score, row_number() OVER (ORDER BY net + 10 * accuracy DESC, strategy) = 1 AS best FROM net")
def _(s, d):
    """Corrections by the whole analysis against those by address and content alone: counts, net, accuracy, score and the best."""
    x = roles.details(_corrected(s, d))
    lead = F.round(F.col("address_doctor") + F.col("content_doctor") - F.col("address_patient") - F.col("content_patient"), 4)
    own = roles.corrected(F.col("role"), F.col("own_role"), F.col("own_confidence"))
    both = F.array(F.struct(F.lit("full").alias("strategy"), F.col("new_role").alias("to")), F.struct(F.lit("own").alias("strategy"), own.alias("to")))
    st = x.withColumn("lead", lead).select("role", "lead", F.inline(both)).where("to is distinct from role")
    g = F.when(F.col("to") == "doctor", F.col("lead")).otherwise(-F.col("lead"))
    per = st.groupBy("strategy").agg(F.count("*").alias("changed"), F.count_if(g > 0).alias("improved"), F.count_if(g < 0).alias("worsened"), F.count_if(g == 0).alias("neutral"))
    per = per.withColumn("net", F.col("improved") - F.col("worsened")).withColumn("accuracy", F.round(F.col("improved") / F.col("changed"), 4)).withColumn("score", F.round(F.col("net") + 10 * F.col("accuracy"), 4))
    top = per.agg(F.max_by("strategy", F.struct("score", "strategy"))).scalar()
    return per.withColumn("best", F.col("strategy") == top)


# Forms that don't go with the role they are given.
NOT_A_PATIENT = {"addresses a patient": ["환자분"], "offers to do": ["해 드리", "해드리", "놔 드리", "놔드리", "드릴게", "드리겠"], "addresses a mother": ["어머님", "어머니"]}
NOT_A_DOCTOR = {"tells feelings": ["살고 싶", "죽고 싶", "한심해서"], "asks a favour": ["잘 부탁", "잘부탁"]}
ANSWERS = ["네", "네.", "예", "예.", "아.", "네, 감사합니다.", "감사합니다", "감사합니다."]


@query("r11_problems", f"WITH {_BASE}, p AS (SELECT file_id, seq, role, list_filter([" + ", ".join(
    [f"CASE WHEN role = 'patient' AND {_has(_T, ws)} THEN '{k}' END" for k, ws in NOT_A_PATIENT.items()]
    + [f"CASE WHEN role = 'doctor' AND (starts_with({_T}, '선생님') OR contains({_T}, '원장님')) THEN 'addresses a doctor' END"]
    + [f"CASE WHEN role = 'doctor' AND {_has(_T, ws)} THEN '{k}' END" for k, ws in NOT_A_DOCTOR.items()]
    + [f"CASE WHEN role = 'doctor' AND trim({_T}, ' ') IN ({', '.join(repr(a) for a in ANSWERS)}) THEN 'only answers' END"]
) + "], lambda x: x IS NOT NULL) AS problems FROM base) SELECT * FROM p WHERE len(problems) > 0")
def _(s, d):
    t = F.coalesce("text", F.lit(""))
    patient, doctor = F.col("role") == "patient", F.col("role") == "doctor"
    found = [F.when(patient & roles._any(t, ws), F.lit(k)) for k, ws in NOT_A_PATIENT.items()]
    found.append(F.when(doctor & (t.startswith("선생님") | t.contains("원장님")), F.lit("addresses a doctor")))
    found += [F.when(doctor & roles._any(t, ws), F.lit(k)) for k, ws in NOT_A_DOCTOR.items()]
    found.append(F.when(doctor & F.trim(t).isin(ANSWERS), F.lit("only answers")))
    return rows(s, d).select("file_id", "seq", "role", F.array_compact(F.array(*found)).alias("problems")).where(F.size("problems") > 0)


_GREETING = f"CASE WHEN length({_T}) <= {roles.GREETINGS[0]} AND {_has(_T, roles.GREETINGS[1])} THEN 'greeting' WHEN length({_T}) <= {roles.FAREWELLS[0]} AND {_has(_T, roles.FAREWELLS[1])} THEN 'farewell' END"


@query("r12_greetings", f"WITH {_BASE} SELECT file_id, seq, role_type, {_GREETING} AS kind FROM base")
def _(s, d):
    return segments(s, d).select("file_id", "seq", roles.role_type(F.col("speaker")).alias("role_type"), roles.greeting(F.col("text")).alias("kind"))


# speakers -----------------------------------------------------------------

_SPOKEN = f"{SEGMENTS_SQL}, t AS (SELECT file_id, coalesce(speaker, '') AS speaker, coalesce(text, '') AS text, seq FROM seg)"
_NETS = " + ".join([f"CASE WHEN bool_or(regexp_matches(text, '{p}')) THEN {float(w)} ELSE 0.0 END" for p, w in roles.SPEAKER_DOCTOR] + [f"CASE WHEN bool_or(regexp_matches(text, '{p}')) THEN {-float(w)} ELSE 0.0 END" for p, w in roles.SPEAKER_PATIENT])
_SPEAKERS = f"""{_SPOKEN}, per AS (SELECT file_id, speaker, round({_NETS} - CASE WHEN regexp_matches(max_by(text, seq), '\\?\\n?\\z') THEN 1.0 ELSE 0.0 END - avg(CASE WHEN len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' '), lambda w: w <> '')) <= 2 THEN 1.0 ELSE 0.0 END) * 4.5, 6) AS net, avg(length(text)) AS mean, sum(length(text)) AS said, min(seq) AS first FROM t GROUP BY file_id, speaker),
 two AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS speakers, row_number() OVER w AS of_two, coalesce(lag(net) OVER w, lead(net) OVER w) AS other, coalesce(lag(mean) OVER w, lead(mean) OVER w) AS other_mean, row_number() OVER (PARTITION BY file_id ORDER BY said DESC, first) AS most FROM per WINDOW w AS (PARTITION BY file_id ORDER BY speaker)),
 led AS (SELECT *, round(net - other + CASE WHEN abs(net - other) < 1.0 THEN CASE WHEN (of_two = 1 AND mean > other_mean) OR (of_two <> 1 AND mean >= other_mean) THEN 1.0 ELSE -1.0 END ELSE 0.0 END, 6) AS lead FROM two),
 spk AS (SELECT file_id, speaker, CASE WHEN CASE speakers WHEN 1 THEN true WHEN 2 THEN lead > 0 OR (lead = 0 AND of_two = 1) ELSE most = 1 END THEN 'doctor' ELSE 'patient' END AS role FROM led)"""


@query("r9_speaker_roles", f"WITH {_SPEAKERS} SELECT * FROM spk")
def _(s, d):
    return roles.speaker_roles(segments(s, d))


def _by_speaker(s, d):
    """Rows whose speaker's role differs from the given one: the changes of a second method."""
    named = roles.speaker_roles(segments(s, d)).withColumnRenamed("role", "new_role")
    return rows(s, d).withColumn("speaker", F.coalesce("speaker", F.lit(""))).join(named, ["file_id", "speaker"]).where("new_role is distinct from role").select("file_id", "seq", "new_role")


_SECOND = f"spk AS (SELECT * FROM (WITH {_SPEAKERS} SELECT * FROM spk)), second AS (SELECT b.file_id, b.seq, k.role AS new_role FROM cor b JOIN spk k ON b.file_id = k.file_id AND coalesce(b.speaker, '') = k.speaker WHERE k.role IS DISTINCT FROM b.role)"


@query("j10_decided_roles", f"WITH {_FULL}, {_SECOND} SELECT c.file_id, c.seq, c.role, coalesce(x.new_role, c.new_role) AS new_role, CASE WHEN x.new_role IS NULL THEN 'kept' WHEN c.new_role IS DISTINCT FROM c.role AND x.new_role = c.new_role THEN 'agree' WHEN c.new_role IS DISTINCT FROM c.role THEN 'overruled' ELSE 'added' END AS decision, CASE WHEN x.new_role IS NULL THEN role_confidence WHEN c.new_role IS DISTINCT FROM c.role AND x.new_role = c.new_role THEN 1.0 WHEN c.new_role IS DISTINCT FROM c.role THEN 0.8 ELSE 0.85 END AS sure FROM cor c LEFT JOIN second x USING (file_id, seq)")
def _(s, d):
    first = _corrected(s, d).select("file_id", "seq", "role", "new_role", F.col("role_confidence").alias("sure"))
    return roles.decided(first, _by_speaker(s, d).withColumnRenamed("new_role", "model_role")).select("file_id", "seq", "role", "new_role", "decision", "sure")


@query("j11_compared_changes", f"WITH {_FULL}, {_SECOND}, a AS (SELECT file_id, seq, new_role FROM cor WHERE new_role IS NOT NULL AND new_role IS DISTINCT FROM role), j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, a.new_role AS a, b.new_role AS b FROM a FULL JOIN second b ON a.file_id = b.file_id AND a.seq = b.seq) SELECT file_id, count(*) FILTER (a = b) AS agree, count(*) FILTER (a <> b) AS disagree, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM j GROUP BY file_id")
def _(s, d):
    a = _corrected(s, d).where("new_role is not null and new_role is distinct from role").select("file_id", "seq", "new_role")
    return roles.compared_changes(a, _by_speaker(s, d))


@query("j12_reattached", f"""WITH {_BASE}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS place FROM base), a AS (SELECT file_id, place, upper(trim(text, ' ')) AS text, role FROM p WHERE confidence >= 0.3 AND trim(text, ' ') <> ''),
 ok AS (SELECT file_id FROM p LEFT JOIN a USING (file_id, place) GROUP BY file_id HAVING count(a.text) >= greatest(1, floor(count(*) * 0.6)))
SELECT p.file_id, p.seq, coalesce(a.text, p.text) AS text, coalesce(a.role, p.role) AS role FROM p LEFT JOIN (SELECT a.* FROM a JOIN ok USING (file_id)) a ON p.file_id = a.file_id AND p.place = a.place""")
def _(s, d):
    """A stand-in for a model gives back the surer rows in capitals; files with under 0.6 of their rows back keep theirs."""
    x = S.batches(rows(s, d), 40).drop("batch")
    answers = x.where("confidence >= 0.3").select("file_id", "place", F.upper("text").alias("text"), "role")
    return roles.reattached(x, answers).select("file_id", "seq", "text", "role")


# notes --------------------------------------------------------------------

_ROLE_WEIGHT = lambda i: f"CASE role_type WHEN 'doctor' THEN {roles.ROLE_WEIGHTS['doctor'][i]} WHEN 'patient' THEN {roles.ROLE_WEIGHTS['patient'][i]} ELSE 1.0 END"
_SCORES = ", ".join("CAST(round((" + " + ".join(f"CASE WHEN contains({_T}, '{w}') THEN {v} ELSE 0.0 END" for w, v in roles.NOTE_WORDS[k].items()) + f") * {_ROLE_WEIGHT(i)}, 4) AS DOUBLE) AS {k}" for i, k in enumerate(roles.CATEGORIES))
_FOUND = ", ".join("(" + " + ".join(f"CASE WHEN contains({_T}, '{w}') THEN 1 ELSE 0 END" for w in roles.NOTE_WORDS[k]) + f") AS n{k}" for k in roles.CATEGORIES)
_NOTES = f"""{_BASE}, ns AS (SELECT file_id, seq, text, role_type, trim({_T}, ' ') = '' AS blank, {_GREETING} AS kind, {_SCORES}, {_FOUND}, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM base)"""
_FOLD = f"""WITH RECURSIVE {_NOTES}, step AS (
  SELECT file_id, 0::BIGINT AS rn, NULL::VARCHAR AS prev, NULL::VARCHAR AS category, 0.0::DOUBLE AS sure FROM (SELECT DISTINCT file_id FROM ns)
  UNION ALL
  SELECT file_id, rn, CASE WHEN category IN ('S', 'O', 'A', 'P') THEN category ELSE prev END, category, CASE WHEN category IN ('greeting', 'farewell') THEN 0.9 WHEN blank THEN 0.0 WHEN total = 0 THEN CASE WHEN category = 'unknown' THEN 0.1 ELSE 0.3 END
    ELSE CASE WHEN CASE category WHEN 'S' THEN nS WHEN 'O' THEN nO WHEN 'A' THEN nA ELSE nP END >= 3 THEN least(top / total + 0.1, 1.0) ELSE top / total END END
  FROM (SELECT *, CASE WHEN blank THEN 'unknown' WHEN kind IS NOT NULL THEN kind WHEN total = 0 THEN CASE role_type WHEN 'patient' THEN 'S' WHEN 'doctor' THEN 'P' ELSE 'unknown' END WHEN s1 = top THEN 'S' WHEN o1 = top THEN 'O' WHEN a1 = top THEN 'A' ELSE 'P' END AS category
    FROM (SELECT *, s1 + o1 + a1 + p1 AS total, greatest(s1, o1, a1, p1) AS top FROM (
      SELECT n.*, step.prev, S + CASE WHEN prev = 'S' THEN 1 ELSE 0 END AS s1, O + CASE WHEN prev = 'O' THEN 1 ELSE 0 END AS o1, A + CASE WHEN prev = 'A' THEN 1 ELSE 0 END AS a1, P + CASE WHEN prev = 'P' THEN 1 ELSE 0 END AS p1
      FROM step JOIN ns n ON n.file_id = step.file_id AND n.rn = step.rn + 1)))
), cat AS (SELECT n.file_id, n.seq, n.text, n.rn, step.category, round(step.sure, 3) AS sure FROM step JOIN ns n ON n.file_id = step.file_id AND n.rn = step.rn)"""


@query("r13_note_scores", f"WITH {_NOTES} SELECT file_id, seq, S, O, A, P FROM ns")
def _(s, d):
    return segments(s, d).select("file_id", "seq", *roles.note_scores(F.col("text"), roles.role_type(F.col("speaker"))))


def _categories(s, d):
    return roles.categorised(segments(s, d).withColumn("role", F.col("speaker")))


@query("seq11_note_categories", f"{_FOLD} SELECT file_id, seq, category FROM cat")
def _(s, d):
    return _categories(s, d).select("file_id", "seq", "category")


@query("r14_note_confidence", f"{_FOLD} SELECT file_id, seq, category, sure FROM cat")
def _(s, d):
    return _categories(s, d)


@query("ag12_note_shares", f"{_FOLD} SELECT file_id, category, count(*) AS segments, round(count(*) / sum(count(*)) OVER (PARTITION BY file_id), 4) AS share, round(sum(sum(sure)) OVER (PARTITION BY file_id) / sum(count(*)) OVER (PARTITION BY file_id), 3) AS mean_sure FROM cat GROUP BY file_id, category")
def _(s, d):
    per = _categories(s, d).groupBy("file_id", "category").agg(F.count("*").alias("segments"), F.sum(F.col("sure").cast("decimal(12,3)")).alias("sure"))
    total = per.groupBy("file_id").agg(F.sum("segments").alias("n"), F.sum("sure").alias("all_sure"))
    x = per.join(total, "file_id")
    return x.select("file_id", "category", "segments", F.round(F.col("segments") / F.col("n"), 4).alias("share"), F.round(F.col("all_sure").cast("double") / F.col("n"), 3).alias("mean_sure"))


_BEST = f"{_FOLD}, best AS (SELECT file_id, category, seq, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS text FROM cat WHERE category IN ('S', 'O', 'A', 'P') QUALIFY row_number() OVER (PARTITION BY file_id, category ORDER BY sure DESC, seq) = 1)"


def _best(s, d):
    """Of each file and category the surest row, the first of several, its text cut to 80 characters."""
    x = _categories(s, d).where(F.col("category").isin(roles.CATEGORIES)).groupBy("file_id", "category").agg(F.max_by("seq", F.struct("sure", -F.col("seq"))).alias("seq"))
    x = x.join(segments(s, d).select("file_id", "seq", "text"), ["file_id", "seq"])
    return x.withColumn("text", F.when(F.length("text") > 80, F.concat(F.left("text", F.lit(80)), F.lit("..."))).otherwise(F.col("text")))


@query("s7_best_note_segments", f"{_BEST} SELECT * FROM best")
def _(s, d):
    return _best(s, d).select("file_id", "category", "seq", "text")


_TITLES = {"S": "[증상] ", "O": "[소견] ", "A": "[진단] ", "P": "[계획] "}
_NOTHING = "분류 가능한 의료 대화 내용이 부족합니다."


@query("r15_note_summary", f"{_BEST}, l AS (SELECT file_id, string_agg(CASE category WHEN 'S' THEN '[증상] ' WHEN 'O' THEN '[소견] ' WHEN 'A' THEN '[진단] ' ELSE '[계획] ' END || text, chr(10) ORDER BY CASE category WHEN 'S' THEN 1 WHEN 'O' THEN 2 WHEN 'A' THEN 3 ELSE 4 END) AS summary FROM best GROUP BY file_id) SELECT f.file_id, coalesce(summary, '{_NOTHING}') AS summary FROM (SELECT DISTINCT file_id FROM seg) f LEFT JOIN l USING (file_id)")
def _(s, d):
    """A line for each category of a file that has one, in the order of the note."""
    title = F.create_map(*[F.lit(x) for kv in _TITLES.items() for x in kv])
    order = F.create_map(*[x for i, k in enumerate(roles.CATEGORIES) for x in (F.lit(k), F.lit(i))])
    line = F.struct(order[F.col("category")].alias("i"), F.concat(title[F.col("category")], F.col("text")).alias("t"))
    lines = _best(s, d).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("summary"))
    files = segments(s, d).select("file_id").distinct()
    return files.join(lines, "file_id", "left").select("file_id", F.coalesce("summary", F.lit(_NOTHING)).alias("summary"))


joined(QUERIES, ORACLES, "h12_signal_details", "signs")
joined(QUERIES, ORACLES, "r7_review_scope", "reasons")
joined(QUERIES, ORACLES, "r11_problems", "problems")

"""Weighted evidence for the speaker's role, phases of a conversation and note categories.

Roles are ``doctor`` and ``patient``; null is unknown. Every function takes its own tables of signs, words and weights;
those below are defaults. A null text holds no sign.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import blocked
from turnmill.session import cut_lineage

_ALONE = r"(?:^|[^\p{L}\p{N}_])%s(?:$|[^\p{L}\p{N}_])"

# How people address each other, with the weight of each form.
DOCTOR_ADDRESS = [
    ("환자분", 1.5), ("어머님", 1.2), ("어머니", 1.2), ("아버지", 1.2), ("아버님", 1.2), ("할머니", 1.2), ("할아버지", 1.2), ("할머님", 1.2), ("할아버님", 1.2), ("보호자분", 1.3), ("보호자", 1.0),
    ("어르신", 1.2), (_ALONE % "뵐게요", 0.8), ("들어오세요", 0.8), (r"안녕히\s*가세요", 0.8), (r"조심히\s*가세요", 0.8), (r"어서\s*오세요", 0.7),
]
PATIENT_ADDRESS = [
    ("^선생님", 1.5), (r"선생님[,\s]", 1.0), ("원장님", 1.5), (r"의사\s*선생님", 1.5), ("교수님", 1.5), ("과장님", 1.3), ("수고하세요", 0.9), ("수고하셨", 0.9), (r"잘\s*부탁", 0.8), (r"잘\s*부탁드", 0.9), (r"감사합니다\s*선생님", 1.2),
]
# What is said: signs of this library, to be replaced by a table of one's own.
DOCTOR_SIGNS = [(r"드릴게요|드리겠습니다", 0.6), (r"어떠세요\?|있으셨어요\?|괜찮으셨어요\?", 0.6), (r"처방|투여|협진|소견", 0.5), (r"드시면 됩니다|쓰셔야|보세요", 0.5), (r"환자분", 0.4), (r"검사를 (?:먼저|미리)", 0.4), (r"걱정하지 않으셔도", 0.6)]
PATIENT_SIGNS = [(r"선생님", 0.5), (r"아파서|아프다고|아픈데", 0.4), (r"(?:먹었|빼고 먹)", 0.4), (r"하나요\?|되나요\?|걸릴까요\?", 0.4), (r"남았어요|빠졌습니다|왔습니다|왔어요", 0.4), (r"걱정이에요|궁금합니다", 0.5)]
TERMS = r"수술|치료|진단|검사|처방|증상|합병증|마취|주사|약물|투여|소견|종양|신경|혈관|조직|소변|혈압|혈당|척추|관절|골절|근육|신장|심장|염증|감염|출혈|당뇨|심전도|내시경|항암"
#: More characters than the first with as many terms as the second are a doctor's, by the third.
LONG_TEXT = (80, 3, 1.0)
# Questions; the phases of a conversation by their words, and the doctor's share of each.
QUESTION = r"[?？]|(?:인가요|건가요|을까요|ㄹ까요|나요|던가요|은가요|가요)\s*$|어떠|어때|어디|언제|몇|얼마|뭐|무엇|누가|왜|어떻게|어디서"
PHASES = {
    "greeting": ["안녕하세요", "반갑습니다", "어서 오세요", "들어오세요", "오셨어요"],
    "complaint": ["어디가 아프", "어디가 불편", "오늘 어떻게", "뭐 때문에", "무엇 때문에", "어떻게 오셨", "어디 불편", "증상이 뭐"],
    "history": ["언제부터", "전에도", "예전에", "과거에", "수술 받은", "병력", "가족 중에", "약 드시는", "복용하는 약", "알레르기"],
    "examination": ["검사를", "찍어보", "확인해", "체크해", "측정", "혈압", "X-ray", "엑스레이", "MRI", "CT", "초음파", "혈액검사", "소변검사"],
    "diagnosis": ["진단", "소견", "결과가", "결과를", "나왔", "보이고", "판단", "의심", "가능성이", "확인됐", "발견됐"],
    "treatment": ["처방", "약을", "주사", "수술", "시술", "물리치료", "치료를", "복용", "드시고", "바르시고", "오시면", "다음에 오"],
    "farewell": ["수고하세요", "감사합니다", "안녕히", "조심히", "다음에 뵐", "잘 가세요", "건강하세요"],
}
DOCTOR_SHARE = {"greeting": 0.5, "complaint": 0.3, "history": 0.4, "examination": 0.6, "diagnosis": 0.8, "treatment": 0.7, "farewell": 0.5}
# Weights of the kinds of evidence; margin of a prediction; least confidence of a correction.
OF_ADDRESS, OF_CONTENT, OF_CONTEXT, OF_FLOW, MARGIN, SURE = 1.0, 0.8, 0.5, 0.3, 0.3, 0.3
# Signs over all that a speaker says, and what a share of short answers weighs.
SPEAKER_DOCTOR = [
    ("수술", 2), ("처방", 2), ("검사", 1.5), ("진단", 2), ("합병증", 2), ("마취", 2), ("재발", 1.5), ("퇴원", 1), ("하셔야", 3), ("되고요", 2), ("입니다", 1), ("거예요", 1), ("거고요", 1.5), ("드릴게요", 2), ("설명드리", 3), ("해주셔야", 2), (r"안\s*하셔도", 1.5), (r"될\s*것\s*같아요", 1.5),
    ("나왔는데", 2), ("나왔고", 1.5), ("결과가", 1.5), ("정상", 1), ("이상", 1), ("수치", 1.5),
]
SPEAKER_PATIENT = [("아파요", 2), ("아프", 1), ("불편", 1.5), ("통증", 1), ("걱정", 1.5), ("인가요", 1.5), ("되나요", 1.5), ("있나요", 1.5), ("어떻게", 1)]
ENDS_ASKING, SHORT_WEIGHT = 1.0, 4.5
# Words of roles, greetings and farewells, with the most characters that such a text has.
ROLE_MARKS = {"doctor": ["원장", "의사", "doctor", "dr", "선생"], "patient": ["환자", "patient", "내원", "보호자"]}
GREETINGS = (50, ["안녕하세요", "안녕하십니까", "반갑습니다", "오셨어요", "오셨습니까", "어서 오세요", "들어오세요", "앉으세요", "어떻게 오셨"])
FAREWELLS = (60, ["감사합니다", "수고하세요", "수고하셨", "고맙습니다", "다음에 뵙", "좋은 하루", "조심히 가세요", "안녕히 가세요", "안녕히 계세요", "건강하세요", "괜찮으실 거", "걱정 마세요", "나아지실"])
# What the role of the speaker weighs in each category of a note.
CATEGORIES = ["S", "O", "A", "P"]
ROLE_WEIGHTS = {"doctor": (0.5, 1.5, 1.5, 1.5), "patient": (1.5, 0.7, 0.5, 0.5), "unknown": (1.0, 1.0, 1.0, 1.0)}
# Words of the categories with their weights: of this library, to be replaced by a table of one's own.
NOTE_WORDS = {
    "S": {"아파": 3.0, "불편": 2.0, "저리": 3.0, "심해": 2.0, "나아졌": 2.0, "걱정": 1.0},
    "O": {"혈압": 3.0, "체온": 3.0, "수치": 2.0, "사진": 2.0, "검사 결과": 3.0, "mg/dL": 3.0},
    "A": {"의심": 3.0, "소견": 3.0, "가능성": 2.0, "정상": 2.0, "부작용": 2.0},
    "P": {"처방": 3.0, "드시면": 2.0, "예약": 3.0, "협진": 3.0, "바꿔 드릴": 2.0, "올릴 수": 2.0},
}


def _said(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def evidence(text: Column, signs: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the signs found."""
    return F.round(sum((F.when(_said(text).rlike(p), float(w)).otherwise(0.0) for p, w in signs), F.lit(0.0)), 4)


def signals(text: Column, signs: list[tuple[str, float]]) -> Column:
    """The signs found, as an array of their patterns."""
    return F.array_compact(F.array(*[F.when(_said(text).rlike(p), F.lit(p)) for p, _ in signs]))


def long_text(text: Column, terms: str = TERMS, rule: tuple[int, int, float] = LONG_TEXT) -> Column:
    """What a long text full of terms weighs for the doctor."""
    most, least, weight = rule
    return F.when((F.length(_said(text)) > most) & (F.regexp_count(_said(text), F.lit(terms)) >= least), weight).otherwise(0.0)


def role_type(label: Column) -> Column:
    """doctor, patient or unknown by the words of a label."""
    t = F.lower(_said(label))
    return F.when(_any(t, ROLE_MARKS["doctor"]), "doctor").when(_any(t, ROLE_MARKS["patient"]), "patient").otherwise("unknown")


def known_role(label: Column) -> Column:
    """doctor or patient by the words of a label, else null."""
    t = role_type(label)
    return F.when(t != "unknown", t)


def greeting(text: Column) -> Column:
    """greeting or farewell for a short text with such words, else null."""
    t = _said(text)
    return F.when((F.length(t) <= GREETINGS[0]) & _any(t, GREETINGS[1]), "greeting").when((F.length(t) <= FAREWELLS[0]) & _any(t, FAREWELLS[1]), "farewell")


def predicted(doctor: Column, patient: Column, margin: float = MARGIN) -> Column:
    """The role with the higher score; null if they lie within ``margin``."""
    return F.when(F.abs(doctor - patient) < margin - 1e-9, None).when(doctor > patient, "doctor").otherwise("patient")


def confidence(doctor: Column, patient: Column) -> Column:
    """Difference over sum of the scores; 0 without any."""
    return F.when(doctor + patient > 0, F.round(F.abs(doctor - patient) / (doctor + patient), 4)).otherwise(0.0)


def merged(score: Column, other: Column, weight: float) -> Column:
    """One score with another of some weight."""
    return F.round(score + other * weight, 4)


def best_of(text: Column, words: dict[str, list[str]]) -> Column:
    """The group with the most words found; the first of several; null without any."""
    t = _said(text)
    hits = {k: sum((F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0)) for k, ws in words.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, None)
    for k, h in hits.items():
        out = out.when(h == most, k)
    return out


def _judged(df: DataFrame) -> DataFrame:
    d, p = F.col("doctor_score"), F.col("patient_score")
    return df.withColumn("predicted_role", predicted(d, p)).withColumn("role_confidence", confidence(d, p))


def details(df: DataFrame, text: str = "text", doctor=DOCTOR_SIGNS, patient=PATIENT_SIGNS) -> DataFrame:
    """Adds the scores of address and content apart: address_doctor, address_patient, content_doctor, content_patient, length."""
    t = F.col(text)
    return (
        df.withColumn("address_doctor", evidence(t, DOCTOR_ADDRESS))
        .withColumn("address_patient", evidence(t, PATIENT_ADDRESS))
        .withColumn("content_doctor", F.round(evidence(t, doctor) + long_text(t), 4))
        .withColumn("content_patient", evidence(t, patient))
        .withColumn("length", F.length(_said(t)))
    )


def scored(df: DataFrame, text: str = "text", doctor=DOCTOR_SIGNS, patient=PATIENT_SIGNS) -> DataFrame:
    """Adds doctor_score and patient_score (address and content by their weights), predicted_role and role_confidence."""
    x = details(df, text, doctor, patient)
    for role in ("doctor", "patient"):
        x = x.withColumn(f"{role}_score", F.round(F.col(f"address_{role}") * OF_ADDRESS + F.col(f"content_{role}") * OF_CONTENT, 4))
    return _judged(x.drop("address_doctor", "address_patient", "content_doctor", "content_patient", "length"))


def with_context(df: DataFrame) -> DataFrame:
    """Adds context_doctor and context_patient from up to three rows before and one after; needs file_id, seq, text, role and predicted_role.

    After a question the other one speaks: 0.6 by the predicted role of the asker, else 0.4 by the given one. Who asks
    isn't the one who is predicted to answer: 0.4. Three rows in a row of one role (predicted, else given) speak for
    that role: 0.45. Without two such rows, the nearest ones of known role, the turn passes on: 0.2. It reads predicted
    and given roles only, so it isn't recursive.
    """
    rows = df.withColumn("block", blocked.block_of(F.col("seq"))).withColumn("__asks", _said(F.col("text")).rlike(QUESTION))
    rows = blocked.shifted(rows, ["file_id"], "block", ["seq"], ["role", "predicted_role", "__asks"], 3, 1)
    rows = rows.select("*", *[F.coalesce(f"prev{i}.predicted_role", F.when(F.col(f"prev{i}.role").isin("doctor", "patient"), F.col(f"prev{i}.role"))).alias(f"__e{i}") for i in (1, 2, 3)])
    e1, e2, e3 = (F.col(f"__e{i}") for i in (1, 2, 3))
    run = F.coalesce((e1 == e2) & (e2 == e3), F.lit(False))
    pair = F.coalesce(F.when(e1.isNotNull(), e2 == e1).when(e2.isNotNull(), e3 == e2), F.lit(False))
    asked, asks = F.coalesce(F.col("prev1.__asks"), F.lit(False)), F.col("__asks")
    before, given, after = F.col("prev1.predicted_role"), F.col("prev1.role"), F.col("next1.predicted_role")

    def score(me: str, other: str) -> Column:
        answer = F.when(asked & (before == other), 0.6).when(asked & before.isNull() & (given == other), 0.4).otherwise(0.0)
        question = F.when(asks & (after == other), 0.4).otherwise(0.0)
        momentum = F.when(run & (e1 == me), 0.45).otherwise(0.0)
        turn = F.when(~pair & (given == other), 0.2).otherwise(0.0)
        return F.round(answer + question + momentum + turn, 4)

    out = rows.withColumn("context_doctor", score("doctor", "patient")).withColumn("context_patient", score("patient", "doctor"))
    return out.drop("block", "__asks", "__e1", "__e2", "__e3", "prev1", "prev2", "prev3", "next1")


def with_flow(df: DataFrame, shares: dict[str, float] = DOCTOR_SHARE) -> DataFrame:
    """Adds phase (filled forward, then backward), phase_changed, flow_doctor and flow_patient (0.4 where a phase is mostly one's)."""
    rows = df.withColumn("block", blocked.block_of(F.col("seq"))).withColumn("__phase", best_of(F.col("text"), PHASES))
    rows = blocked.filled(rows, ["file_id"], "block", ["seq"], "__phase", "phase")
    rows = blocked.neighbours(rows, ["file_id"], "block", ["seq"], ["phase"])
    share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("phase"))
    changed = F.coalesce(F.col("prev_phase") != F.col("phase"), F.lit(False))
    out = rows.withColumn("phase_changed", changed).withColumn("flow_doctor", F.when(share >= 0.7, 0.4).otherwise(0.0)).withColumn("flow_patient", F.when(share <= 0.35, 0.4).otherwise(0.0))
    return out.drop("block", "__phase", "prev_phase")


def analysed(df: DataFrame) -> DataFrame:
    """The whole analysis of (file_id, seq, text, role): address and content, with context and flow by their weights.

    Adds own_role and own_confidence (address and content alone), doctor_score, patient_score, predicted_role,
    role_confidence and phase.
    """
    # each of the two reads its input more than once: written in between, the plan stays small
    x = with_flow(cut_lineage(with_context(scored(df))))
    x = x.withColumn("own_role", F.col("predicted_role")).withColumn("own_confidence", F.col("role_confidence")).withColumn("has_signal", F.col("doctor_score") + F.col("patient_score") > 0)
    for role in ("doctor", "patient"):
        with_near = merged(F.col(f"{role}_score"), F.col(f"context_{role}"), OF_CONTEXT)
        x = x.withColumn(f"{role}_score", merged(with_near, F.col(f"flow_{role}"), OF_FLOW))
    return _judged(x.drop("context_doctor", "context_patient", "flow_doctor", "flow_patient", "phase_changed"))


def corrected(role: Column, predicted_role: Column, sure: Column, least: float = SURE) -> Column:
    """The predicted role where it differs and is sure enough, else the given one."""
    return F.when(predicted_role.isNotNull() & ~predicted_role.eqNullSafe(role) & (sure >= least), predicted_role).otherwise(role)


def model_roles(df: DataFrame, ask: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 300) -> DataFrame:
    """(file_id, seq, model_role) from an outside model: ``ask`` gets batches of (file_id, seq, role, text), texts cut to ``most`` characters."""
    return df.select("file_id", "seq", "role", F.left("text", F.lit(most)).alias("text")).mapInArrow(ask, "file_id string, seq int, model_role string")


def decided(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Roles after a model's changes: (file_id, seq, role, new_role) meet (file_id, seq, model_role).

    Both agree: confidence 1; they differ: the model's, 0.8; only the model changes: 0.85; else what was decided before.
    """
    x = df.join(changes.groupBy("file_id", "seq").agg(F.min("model_role").alias("model_role")), ["file_id", "seq"], "left")
    changed = ~F.col("new_role").eqNullSafe(F.col("role"))
    m = F.col("model_role")
    how = F.when(m.isNull(), "kept").when(changed & (m == F.col("new_role")), "agree").when(changed, "overruled").otherwise("added")
    sure = F.when(how == "agree", 1.0).when(how == "overruled", 0.8).when(how == "added", 0.85).otherwise(F.col("sure"))
    return x.withColumn("decision", how).withColumn("sure", sure).withColumn("new_role", F.coalesce(m, "new_role")).drop("model_role")


def compared_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per file, how two methods' changes (file_id, seq, new_role) relate: agree, disagree, only_a, only_b."""
    x = a.select("file_id", "seq", F.col("new_role").alias("a")).join(b.select("file_id", "seq", F.col("new_role").alias("b")), ["file_id", "seq"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.groupBy("file_id").agg(
        F.count_if(both & (F.col("a") == F.col("b"))).alias("agree"),
        F.count_if(both & (F.col("a") != F.col("b"))).alias("disagree"),
        F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"),
    )


def reattached(df: DataFrame, answers: DataFrame, least: float = 0.6) -> DataFrame:
    """Texts and roles that a model gave back by (file_id, place), taken only for files of which it gave at least that share.

    Blank texts are no answer; of several for a place the least one counts; only known roles are taken.
    """
    ok = answers.where((F.col("place") > 0) & (F.trim("text") != "")).groupBy("file_id", "place").agg(F.min(F.struct(F.trim("text").alias("text"), "role")).alias("__a"))
    total = df.groupBy("file_id").agg(F.count("*").alias("__n"))
    given = ok.groupBy("file_id").agg(F.count("*").alias("__m")).join(total, "file_id")
    taken = given.where(F.col("__m") >= F.greatest(F.lit(1), F.floor(F.col("__n") * least))).select("file_id")
    x = df.join(ok.join(taken, "file_id"), ["file_id", "place"], "left")
    role = F.when(F.col("__a.role").isin("doctor", "patient"), F.col("__a.role"))
    return x.withColumn("text", F.coalesce("__a.text", "text")).withColumn("role", F.coalesce(role, "role")).drop("__a")


def speaker_roles(df: DataFrame) -> DataFrame:
    """(file_id, speaker, role) from what each speaker of a file says in all.

    Signs count once a speaker, a share of answers of up to two words speaks for the patient. One speaker is the
    doctor. Of two it is the one with the higher net score, the longer mean text adding 1 where they lie within 1; of
    three or more the one who says most, the first to speak of several. A null speaker is one of its own.
    """
    t = _said(F.col("text"))
    rows = df.withColumn("speaker", F.coalesce("speaker", F.lit(""))).withColumn("text", t)
    words = F.size(F.filter(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), lambda w: w != ""))
    # a bit for each sign, so that one buffer holds what was found in any of the texts
    weighed = [(p, float(w)) for p, w in SPEAKER_DOCTOR] + [(p, -float(w)) for p, w in SPEAKER_PATIENT]
    rows = rows.withColumn("signs", sum((F.when(F.col("text").rlike(p), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, (p, _) in enumerate(weighed)), F.lit(0).cast("bigint")))
    found = F.bit_or("signs")
    net = F.aggregate(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, (_, w) in enumerate(weighed)]), F.lit(0.0), lambda acc, x: acc + F.getbit(found, x["i"]) * x["w"])
    net = net - F.when(F.max_by("text", "seq").rlike(r"\?\n?\z"), ENDS_ASKING).otherwise(0.0) - F.avg((words <= 2).cast("double")) * SHORT_WEIGHT
    per = rows.groupBy("file_id", "speaker").agg(F.round(net, 6).alias("net"), F.avg(F.length("text")).alias("mean"), F.sum(F.length("text")).alias("said"), F.min("seq").alias("first"))
    w, by = Window.partitionBy("file_id"), Window.partitionBy("file_id").orderBy("speaker")
    other = lambda c: F.coalesce(F.lag(c).over(by), F.lead(c).over(by))  # noqa: E731 - the other one of two
    per = per.withColumn("speakers", F.count("*").over(w)).withColumn("of_two", F.row_number().over(by)).withColumn("other", other("net")).withColumn("other_mean", other("mean"))
    close = F.abs(F.col("net") - F.col("other")) < 1.0
    # the first of two gets the point for a longer mean, the second one for a mean at least as long
    mine = F.when(F.col("of_two") == 1, F.col("mean") > F.col("other_mean")).otherwise(F.col("mean") >= F.col("other_mean"))
    lead = F.round(F.col("net") - F.col("other") + F.when(close, F.when(mine, 1.0).otherwise(-1.0)).otherwise(0.0), 6)
    most = F.row_number().over(w.orderBy(F.desc("said"), "first")) == 1
    doctor = F.when(F.col("speakers") == 1, True).when(F.col("speakers") == 2, (lead > 0) | ((lead == 0) & (F.col("of_two") == 1))).otherwise(most)
    return per.select("file_id", "speaker", F.when(doctor, "doctor").otherwise("patient").alias("role"))


# notes -------------------------------------------------------------------


def note_matches(text: Column, words: dict[str, dict[str, float]] = NOTE_WORDS) -> Column:
    """struct(S, O, A, P) of the words of each category that the text holds."""
    t = _said(text)
    return F.struct(*[F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in words[k]])).alias(k) for k in CATEGORIES])


def note_scores(text: Column, role: Column, words: dict[str, dict[str, float]] = NOTE_WORDS) -> list[Column]:
    """The weights of the words found in each category, by the weight of the speaker's role (doctor, patient, unknown)."""
    t = _said(text)
    out = []
    for i, k in enumerate(CATEGORIES):
        own = F.when(role == "doctor", ROLE_WEIGHTS["doctor"][i]).when(role == "patient", ROLE_WEIGHTS["patient"][i]).otherwise(ROLE_WEIGHTS["unknown"][i])
        out.append(F.round(sum((F.when(F.contains(t, F.lit(w)), v).otherwise(0.0) for w, v in words[k].items()), F.lit(0.0)) * own, 4).alias(k))
    return out


#: Categories by number; what is said in greeting, at the end, or without any sign has none of a note.
NAMES = np.array([*CATEGORIES, "unknown", "greeting", "farewell"])
_UNKNOWN, _GREETING, _FAREWELL = 4, 5, 6


def _states(scores: np.ndarray, fixed: np.ndarray, default: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(category, state after) of every row for each state before: none, S, O, A, P.

    ``fixed`` is the category of a row that needs no scores, else -1; ``default`` that of one without any score.
    """
    n = len(scores)
    category = np.empty((n, 5), np.int8)
    for state in range(5):
        s = scores.copy()
        if state:
            s[:, state - 1] += 1.0
        category[:, state] = np.where(fixed >= 0, fixed, np.where(s.sum(1) == 0, default, s.argmax(1)))
    after = np.where(category < _UNKNOWN, category + 1, np.arange(5, dtype=np.int8)[None, :])
    return category, after.astype(np.int8)


def _composed(after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every row the state after it by the state before its segment, composed in log steps; ``first`` is each row's segment start."""
    out, at, step = after.copy(), np.arange(len(after)), 1
    longest = int((at - first).max()) + 1 if len(after) else 0
    while step < longest:
        inside = np.flatnonzero(at - step >= first)
        out[inside] = np.take_along_axis(out[inside], out[inside - step].astype(np.int64), 1)
        step *= 2
    return out


def _flat(b: pa.RecordBatch) -> tuple:
    lists = b.column("rows")
    rows, sizes = lists.flatten(), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    scores = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in CATEGORIES], 1)
    fixed, default = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("fixed", "default"))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows, sizes, first, scores, *_states(scores, fixed, default)


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of states of every block."""
    for b in batches:
        _, sizes, first, _, _, after = _flat(b)
        ends = _composed(after, first)[np.cumsum(sizes) - 1]
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("block"), pa.array(list(ends.astype(np.int32)), pa.list_(pa.int32()))], ["file_id", "block", "ends"])


def _first_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before every block: maps come by file and block, and one state goes on from map to map."""
    file, state = None, 0
    for b in batches:
        out = []
        for f, ends in zip(b.column("file_id").to_pylist(), b.column("ends").to_pylist()):
            if f != file:
                file, state = f, 0
            out.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("block"), pa.array(out, pa.int32())], ["file_id", "block", "state"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, sizes, first, scores, category, after = _flat(b)
        start = np.repeat(b.column("state").to_numpy(), sizes).astype(np.int64)
        at = np.arange(len(start))
        ends = _composed(after, first)
        before = np.where(at > first, ends[np.maximum(at - 1, 0), start], start)
        mine = category[at, before]
        note, matched = mine < _UNKNOWN, rows.field("matched").flatten()
        boosted = scores.copy()
        held = np.flatnonzero(before > 0)
        boosted[held, before[held] - 1] += 1.0
        total = boosted.sum(1)
        k = np.minimum(mine, 3).astype(np.int64)
        counts = np.asarray(matched.to_numpy(zero_copy_only=False)).reshape(-1, 4)[at, k] if len(at) else np.empty(0)
        sure = np.where(total > 0, boosted[at, k] / np.maximum(total, 1e-9), 0.3)
        sure = np.where((total > 0) & (counts >= 3), np.minimum(sure + 0.1, 1.0), sure)
        blank = rows.field("blank").to_numpy(zero_copy_only=False)
        sure = np.where(note, sure, np.where(mine == _UNKNOWN, np.where(blank, 0.0, 0.1), 0.9))
        yield pa.RecordBatch.from_arrays(
            [b.column("file_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), rows.field("seq"), pa.array(NAMES[mine]), pa.array(sure)],
            ["file_id", "seq", "category", "sure"],
        )


def categorised(df: DataFrame, words: dict[str, dict[str, float]] = NOTE_WORDS) -> DataFrame:
    """(file_id, seq, category, sure) of (file_id, seq, text, role): S, O, A, P, greeting, farewell or unknown, and how sure.

    The category of a note before adds 1 to its own score, so the rule is recursive along the file. A row maps the
    category before it to the one after it; the maps of a block compose to one, the few maps of a file are followed in
    order, and each block is then resolved from its first state. So no file is walked in one task.

    A blank text is unknown with 0; greetings and farewells have 0.9. Without any score a patient's row is S and a
    doctor's P with 0.3, any other unknown with 0.1. Three words or more add 0.1 to the share of the best score.
    """
    t, role = F.col("text"), role_type(F.col("role"))
    blank = F.trim(_said(t)) == ""
    kind = greeting(t)
    fixed = F.when(blank, _UNKNOWN).when(kind == "greeting", _GREETING).when(kind == "farewell", _FAREWELL).otherwise(-1).cast("int")
    default = F.when(role == "patient", 0).when(role == "doctor", 3).otherwise(_UNKNOWN).cast("int")
    found = note_matches(t, words)
    counts = F.array(*[F.size(found[k]) for k in CATEGORIES])
    rows = df.select("file_id", "seq", blocked.block_of(F.col("seq")).alias("block"), *note_scores(t, role, words), fixed.alias("fixed"), default.alias("default"), blank.alias("blank"), counts.alias("matched"))
    block = rows.groupBy("file_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", *CATEGORIES, "fixed", "default", "blank", "matched"))).alias("rows"))  # at most a block of rows
    maps = block.mapInArrow(_block_maps, "file_id string, block bigint, ends array<int>")
    starts = maps.repartition("file_id").sortWithinPartitions("file_id", "block").mapInArrow(_first_states, "file_id string, block bigint, state int")
    done = block.join(starts, ["file_id", "block"])
    return done.mapInArrow(_resolved, "file_id string, seq int, category string, sure double").withColumn("sure", F.round("sure", 3))

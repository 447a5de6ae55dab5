"""Detection of misheard words, word sequence models and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.cleaning import only_particle_differs
from turnmill.functions.text import char_jaccard, without_particle
from turnmill.operators.joins import similar_words
from turnmill.operators.rules import CHANGES, Corrector, corrected, learnable
from turnmill.session import cut_lineage


# Words that are never taken for misheard terms, and particles, the longest first.
SAFE_WORDS = (
    "영상 사진 화면 소리 시간 기간 방법 방향 상태 상황 관계 관련 부분 부위 기능 기본 정도 정상 주변 주위 내용 내부 외부 전체 현재 이전 이후 이상 이하 결과 검사 치료 수술 설명 운동 생활 식사 음식 감사 인사"
    " 남성 여성 나이 연세 비용 자기 본인 우리 거기 여기 저기 어디 언제 어떻게 다음 처음 병원 선생님 환자 보호자 가족 아버지 어머니 아들 딸 남편 아내 형제 자매 하고 하면 하는 하는데 한다 했어 했는데 같은 같이 있는 없는 되는 많은 좋은"
    " 이런 그런 저런 아직 지금 오늘 내일 상담 보험 급여 서류 진료 예약 접수 대기 처방 입원 퇴원 외래 재활 통증 증상 약물 복용 경과 검진 진단 골반 무릎 허리 어깨 발목 손목 척추 고관절 가슴 머리 골절 연골 인대 관절 근육 혈관 신경"
    " 세포 조직 피부 혈액 소변 대변 호흡 맥박 혈압 수액 주사 캡슐 알약 연고 시술 마취 초음파 내시경 심전도 합병증 재발 혈전 종양"
).split()
PARTICLES = (
    "에서부터 에서는 에서도 에서의 으로는 으로도 으로서 으로의 에게는 에게도 에게서 까지는 까지도 부터는 이라는 이라고 이라면 으로 에서 에게 까지 부터 처럼 같이 보다 에는 에도 이라 이나 이든 이고 인데 이면 이랑 과는 와는"
    " 에 을 를 은 는 이 가 도 와 과 의 로 만"
).split()
AUTO, REVIEW = 0.85, 0.70


def _stem(c: Column, particles: list[str]) -> Column:
    return without_particle(c, particles)


def candidates(words: DataFrame, vocabulary: DataFrame, scope: str | None = None, least: float = 0.6, top: int = 3) -> DataFrame:
    """(word, term, specialty, similarity, place): the most similar terms of each distinct word.

    With a scope that the vocabulary has, its terms alone are offered; a word that finds none there is looked up among
    all. A term of several specialties counts under the least of them.
    """
    named = vocabulary.where("term is not null").select("term", "specialty")

    def found(w: DataFrame, v: DataFrame) -> DataFrame:
        of = v.groupBy("term").agg(F.min("specialty").alias("specialty"))
        return similar_words(w, v.select("term"), least, top).join(of, "term").select("word", "term", "specialty", "similarity", "place")

    if scope is None:
        return found(words, named)
    inside = found(words, named.where(F.col("specialty") == scope))
    rest = words.select("word").distinct().join(inside.select("word").distinct(), "word", "left_anti")
    return inside.unionByName(found(rest, named))


def misheard(words: DataFrame, vocabulary: DataFrame, rules: DataFrame, particles: list[str] = PARTICLES, safe: list[str] = SAFE_WORDS, scope: str | None = None, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """(word, term, specialty, similarity, action) of distinct words that may be misheard terms.

    Passed over, in order: safe words and words with a safe stem; words of enabled rules; exact terms, also by their
    stem; words of which a candidate is the word itself; those that differ from the best candidate by particles only;
    those whose best candidate is a safe word. The similarity of the best candidate decides: replace from ``auto`` on,
    review from ``review`` on, else ignore.
    """
    w = words.where(F.length("word") >= 2).select("word").distinct().withColumn("stem", _stem(F.col("word"), particles))
    if safe:
        w = w.where(~F.col("word").isin(list(safe)) & ~F.col("stem").isin(list(safe)))
    on = rules.where("enabled") if "enabled" in rules.columns else rules
    known = on.select(F.col("wrong").alias("word")).union(on.select("correct")).where("word is not null").distinct()
    terms = vocabulary.where("term is not null").select(F.col("term").alias("word")).distinct()
    w = w.join(known, "word", "left_anti").join(terms, "word", "left_anti").join(terms.withColumnRenamed("word", "stem"), "stem", "left_anti")
    best = candidates(w.select("word"), vocabulary.select("term", vocabulary.specialty if "specialty" in vocabulary.columns else F.lit("general").alias("specialty")), scope, top=1).drop("place")
    if particles:
        best = best.where(~only_particle_differs(F.col("word"), F.col("term"), list(particles)))
    if safe:
        best = best.where(~F.col("term").isin(list(safe)))
    action = F.when(F.col("similarity") >= auto, "replace").when(F.col("similarity") >= review, "review").otherwise("ignore")
    return best.select("word", "term", "specialty", "similarity", action.alias("action"))


def scoped(hits: DataFrame, scopes: list[str], bonus: float = 0.02, top: int = 3) -> DataFrame:
    """Of candidates (word, term, similarity, specialty) in one of the scopes the ``top`` best, those of the first scope weighing ``bonus`` more; without any scope none."""
    if not scopes:
        return hits.withColumn("score", F.col("similarity")).withColumn("place", F.lit(1)).limit(0)
    s = F.round(F.col("similarity") + F.when(F.col("specialty") == scopes[0], bonus).otherwise(0.0), 6)
    order = F.array_position(F.array(*map(F.lit, scopes)), F.col("specialty"))
    w = Window.partitionBy("word").orderBy(F.desc("score"), order, "term")
    return hits.where(F.col("specialty").isin(scopes)).withColumn("score", s).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def applied(texts: DataFrame, found: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Second tier: (key, text, logs, replaced, pending) from the words found by ``misheard``.

    In the order in which words first occur, sure ones are replaced everywhere in the text, unsure ones are only
    logged. Texts meet the distinct words, never the vocabulary. What is learned from one batch of texts serves the next.
    """
    of = found.where("action <> 'ignore'").select("word", "term", "similarity", "action")
    said = texts.select(*key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("([가-힣]{2,})"), 1)).alias("at", "word")).groupBy(*key, "word").agg(F.min("at").alias("at"))
    hits = said.join(of, "word").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "word", "term", "similarity", "action"))).alias("__hits"))
    x = texts.select(*key, F.col(text).alias("text")).join(hits, key, "left")
    none = F.array().cast(CHANGES)
    start = F.struct(F.col("text"), none.alias("logs"))

    def step(acc: Column, h: Column) -> Column:
        sure = h["action"] == "replace"
        go = ~sure | F.contains(acc["text"], h["word"])
        how = F.concat(F.when(sure, F.lit("auto_")).otherwise(F.lit("review_")), F.format_string("%.2f", h["similarity"]))
        entry = F.struct(h["word"].alias("original"), h["term"].alias("corrected"), how.alias("rule"), F.when(sure, F.lit("tier2_auto")).otherwise(F.lit("tier2_review")).alias("tier"))
        logs = F.when(go, F.concat(acc["logs"], F.array(entry))).otherwise(acc["logs"])
        return F.struct(F.when(sure, F.replace(acc["text"], h["word"], h["term"])).otherwise(acc["text"]).alias("text"), logs.alias("logs"))

    done = F.aggregate(F.coalesce("__hits", F.array().cast("array<struct<at: int, word: string, term: string, similarity: double, action: string>>")), start, step)
    y = x.select(*key, done.alias("x")).select(*key, "x.text", "x.logs")
    of_tier = lambda t: F.size(F.filter("logs", lambda l: l["tier"] == t))
    return y.withColumn("replaced", of_tier("tier2_auto")).withColumn("pending", of_tier("tier2_review"))


def corrected_in_full(texts: DataFrame, corrector: Corrector, vocabulary: DataFrame, rules: DataFrame, key: list[str], text: str = "text", scope: str | None = None) -> DataFrame:
    """Both tiers: (key, text, logs, tier1, tier2, pending). A null text stays null, with no logs."""
    one = cut_lineage(texts.select(*key, corrected(F.col(text), corrector).alias("x")).select(*key, "x.text", "x.logs"))
    words = one.select(F.explode(F.regexp_extract_all("text", F.lit("([가-힣]{2,})"), 1)).alias("word")).distinct()
    two = applied(one, misheard(words, vocabulary, rules, scope=scope), key).withColumnRenamed("logs", "logs2")
    x = one.drop("text").join(two, key)
    first = F.size(F.filter("logs", lambda l: l["tier"] == "tier1_dict"))
    return x.select(*key, "text", F.concat(F.coalesce("logs", F.array().cast(CHANGES)), "logs2").alias("logs"), F.coalesce(first, F.lit(0)).alias("tier1"), F.col("replaced").alias("tier2"), "pending")


def learned(found: DataFrame, rules: DataFrame, particles: list[str] = PARTICLES, safe: list[str] = SAFE_WORDS) -> DataFrame:
    """New rules (wrong, correct, priority, category, notes) from sure finds, as far as they pass the gates of ``learnable``."""
    sure = found.where("action = 'replace'")
    new = learnable(sure.select(F.col("word").alias("wrong"), F.col("term").alias("correct")), rules, safe, particles)
    of = sure.select(F.col("word").alias("wrong"), "specialty", "similarity")
    return new.join(of, "wrong").select("wrong", "correct", "priority", F.col("specialty").alias("category"), F.format_string("auto (similarity %.2f, source=auto)", F.col("similarity")).alias("notes"))


def queued(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The review queue with new finds as pending; words already queued aren't added again."""
    new = found.where("action = 'review'").select("word", "term", "similarity").join(queue.select("word", "term"), ["word", "term"], "left_anti")
    return queue.unionByName(new.withColumn("status", F.lit("pending")))


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending entries take the decision (approved or rejected); settled ones keep theirs."""
    d = decisions.select("word", "term", F.col("status").alias("__new")).where("__new in ('approved', 'rejected')").dropDuplicates(["word", "term"])
    out = queue.join(d, ["word", "term"], "left")
    return out.withColumn("status", F.when(F.col("status") == "pending", F.coalesce("__new", "status")).otherwise(F.col("status"))).drop("__new")


def _word_list(text: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.trim(F.col(text)), r"\s+", " "), " "), lambda x: x != "")


def _pairs(words: Column) -> Column:
    """Neighbouring words as structs (a, b)."""
    return F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(F.element_at(words, i).alias("a"), F.element_at(words, i + 1).alias("b"))))


def bigram_scores(texts: DataFrame, model: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, words, score): the log probabilities of each text's word pairs by its number of words, under the counts of ``model``.

    Probabilities are smoothed by one; a pair whose first word the model doesn't know has one over the number of its
    words and one. A text of one word, or of none, scores 0; a null text isn't scored.
    """
    w = texts.where(F.col(text).isNotNull()).select(*key, _word_list(text).alias("w"))
    m = model.where(F.col(text).isNotNull()).select(_word_list(text).alias("w"))
    one = m.select(F.explode("w").alias("a")).groupBy("a").agg(F.count("*").alias("na"))
    two = m.select(F.inline(_pairs(F.col("w")))).groupBy("a", "b").agg(F.count("*").alias("nab"))
    size = F.coalesce(one.agg(F.count("*").alias("v")).scalar(), F.lit(0))
    pairs = w.select(*key, F.inline(_pairs(F.col("w"))))
    # each distinct pair is scored once and then met by its occurrences
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("__n")).drop("__n").join(one, "a", "left").join(two, ["a", "b"], "left")
    p = F.when(F.col("na").isNull(), F.log(1 / (size + 1))).otherwise(F.log((F.coalesce("nab", F.lit(0)) + 1) / (F.col("na") + size)))
    sums = pairs.join(met.select("a", "b", p.alias("p")), ["a", "b"]).groupBy(*key).agg(F.sum("p").alias("p"))
    words = w.select(*key, F.size("w").alias("words"))
    return words.join(sums, key, "left").select(*key, "words", F.round(F.coalesce(F.col("p"), F.lit(0.0)) / F.greatest("words", F.lit(1)), 6).alias("score"))


def unseen_pairs(texts: DataFrame, model: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, a, b): neighbouring words whose first is known to the model but whose pair never occurred in it."""
    pairs_of = lambda df, k: df.where(F.col(text).isNotNull()).select(*k, F.filter(F.split(text, " "), lambda x: x != "").alias("w")).where(F.size("w") >= 2).select(*k, F.inline(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))))
    seen = pairs_of(model, []).distinct()
    known = model.where(F.col(text).isNotNull()).select(F.explode(F.split(text, " ")).alias("a")).where("a <> ''").distinct()
    return pairs_of(texts, key).join(known, "a", "left_semi").join(seen, ["a", "b"], "left_anti").select(*key, "a", "b").distinct()


# What a candidate loses for an odd length, for months and numbers that run on, and for few different words.
ODD_LENGTH, MONTHS, NUMBERS, FEW_WORDS = 5.0, 100.0, 50.0, 20.0


def candidate_score(lm: Column, text: Column, mean_length: Column) -> Column:
    """Ten times the model's score, less the penalties; ``mean_length`` is that of all candidates."""
    ratio = F.length(text) / F.greatest(mean_length, F.lit(1.0))
    words = F.filter(F.split(F.regexp_replace(F.trim(text), r"\s+", " "), " "), lambda x: x != "")
    few = (F.size(words) > 3) & (F.size(F.array_distinct(words)) < 0.3 * F.size(words))
    off = [
        ((ratio < 0.5) | (ratio > 2.0), ODD_LENGTH),
        (text.rlike(r"(?:\d{2,}월부터\.?\s*){3,}"), MONTHS),
        (text.rlike(r"(?:\d\s+){6,}"), NUMBERS),
        (few, FEW_WORDS),
    ]
    return 10 * lm - sum((F.when(c, w).otherwise(0.0) for c, w in off), F.lit(0.0))


def best_candidates(candidates: DataFrame, model: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """Of each group's candidate texts the one with the highest score, the first by ``order`` of several; null texts are none."""
    c = candidates.where(F.col(text).isNotNull()).select(*group, order, F.col(text).alias("text"))
    scores = bigram_scores(c, model.select(F.col(text).alias("text")), [*group, order]).drop("words")
    mean = c.groupBy(*group).agg(F.avg(F.length("text")).alias("__mean"))
    x = c.join(scores, [*group, order]).join(mean, group).withColumn("score", F.round(candidate_score(F.col("score"), F.col("text"), F.col("__mean")), 6))
    best = F.max_by(F.struct("text", "score", order), F.struct(F.col("score"), -F.col(order)))
    return x.groupBy(*group).agg(best.alias("b"), F.count("*").alias("candidates")).select(*group, "candidates", f"b.{order}", "b.score", "b.text")


# Broken terms, words one of which must be near, and what they may stand for; with ``head`` near, one of
# ``needs`` decides for the first candidate. The second rule of each dialogue is applied to what the first one made.
GLOSSARY_RULES = [
    {"pattern": r"당월\s*섭스", "anchors": ["혈당", "당뇨", "공복", "식후", "췌장", "인슐린", "주사", "펜", "단위", "당화", "혈색소", "혈색"], "candidates": ["당화혈색소"], "head": None, "needs": []},
    {"pattern": "이슈주의", "anchors": ["인슐린", "주사", "펜", "단위", "혈당", "공복", "식후", "췌장"], "candidates": ["인슐린 주사", "인슐린 펜", "인슐린"], "head": "인슐린", "needs": ["주사", "펜", "단위"]},
]


def glossary_corrected(text: Column, near: Column, rules: list[dict] = GLOSSARY_RULES) -> Column:
    """The first match of each rule's pattern replaced where one of its anchors is near.

    The longest candidate that is mentioned near is taken, else by the head word, else the first one.
    """

    def any_of(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(near, F.lit(w))
        return found

    for r in rules:
        pick = F.when(F.lit(False), F.lit(None).cast("string"))
        for c in sorted(r["candidates"], key=len, reverse=True):
            pick = pick.when(F.contains(near, F.lit(c)), c)
        if r["head"]:
            pick = pick.when(any_of(r["needs"]) & F.contains(near, F.lit(r["head"])), r["candidates"][0]).when(F.contains(near, F.lit(r["head"])), r["head"])
        pick = pick.otherwise(r["candidates"][0])
        at = F.regexp_instr(text, F.lit(r["pattern"]))
        rest = F.substring(text, at + F.length(F.regexp_extract(text, r["pattern"], 0)), F.length(text))
        text = F.when(any_of(r["anchors"]) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), pick, rest)).otherwise(text)
    return text


# What recognition says in silence.
BANNED = ["시청해", "구독", "좋아요", "알림 설정", "자막", "유튜브"]


def looks_hallucinated(text: Column, other: Column, mean_logprob: Column, no_speech: Column, banned: list[str] = BANNED) -> Column:
    """Whether a second recognition of a piece of speech is made up, beside the first one (``other``).

    Fewer than three characters; a banned phrase; a mean log probability under -0.9; likely silence and fewer than 50
    characters; a short list of short words between commas unlike the first; nothing in common with a first one of six
    characters or more.
    """
    t, o = F.coalesce(F.trim(text), F.lit("")), F.coalesce(F.trim(other), F.lit(""))
    parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")
    alike = char_jaccard(o, t)
    listed = (F.size(parts) >= 3) & (F.length(t) <= 48) & F.forall(parts, lambda p: F.length(p).between(2, 14)) & ((o == "") | (alike < 0.2))
    apart = (F.length(o) >= 6) & (alike < 0.06) & (F.length(t) >= 8)
    unlikely = F.coalesce(mean_logprob < -0.9, F.lit(False)) | (F.coalesce(no_speech > 0.5, F.lit(False)) & (F.length(t) < 50))
    return (F.length(t) < 3) | F.exists(F.array(*map(F.lit, banned)), lambda b: F.contains(t, b)) | unlikely | listed | apart

import math

import pytest
from pyspark.sql import functions as F

from turnmill.functions import cleaning as C
from turnmill.operators import detection as D
from turnmill.operators import rules


@pytest.mark.parametrize("text,out", [
    ("혈압 백이십에 팔십으로 나왔어요", "혈압 120/80으로 나왔어요"), ("하루 세 번 드세요", "하루 3번 드세요"), ("오백 밀리그램", "500mg") if False else ("오백밀리그램 드세요", "500mg 드세요"),
    ("두 달 뒤", "2달 뒤"), ("두 시간 뒤", "두 시간 뒤"), ("십오 분 뒤", "15분 뒤"), ("이백영오 일", "205일"), ("서른 번", "30번"), ("스물 개", "20개"), ("오 밀리몰", "5mmol"), ("삼 유닛", "3U"), ("두통이 두 번", "두통이 2번"), ("일일이회", "1일 2회"), ("이 환자는 일 하나", "이 환자는 일 하나"), ("오십에 백으로", "오십에 백으로"), ("", ""),
])
def test_numerals(text, out):
    assert C.numerals(text) == out


def test_cleaning_columns(spark):
    df = spark.createDataFrame([("어... 어디가 아프신가요. 1월 2월 3월 4월 끝",), (None,), ("",), ("```json\n{}\n```",)], "t string")
    got = df.select(C.without_fillers(F.col("t")), C.question_marks(F.col("t")), C.without_sequences(F.col("t")), C.without_fences(F.col("t")), C.first_only(F.col("t"), "어", "X"), C.polished(F.col("t"))).collect()
    assert got[0][0].startswith("어디가") and "아프신가요" in got[0][1] and got[0][4].startswith("X... 어디가")
    assert got[3][3] == "{}" and all(x is None for x in got[1]) and got[2][0] == ""


RULES = [
    {"id": "1", "wrong": "쌈전도", "correct": "심전도", "strategy": "phonetic", "pattern": None, "confidence": 0.7, "hints": ["검사"]},
    {"id": "2", "wrong": "당료", "correct": "당뇨", "strategy": "exact", "pattern": None, "confidence": 1.0, "hints": []},
    {"id": "3", "wrong": "x", "correct": r"\1 mg", "strategy": "regex", "pattern": r"(\d+)mg", "confidence": 1.0, "hints": []},
    {"id": "4", "wrong": "x", "correct": "y", "strategy": "regex", "pattern": "(a)(b", "confidence": 1.0, "hints": []},
    {"id": "5", "wrong": "당뇨병", "correct": "당뇨 병", "strategy": "exact", "pattern": None, "confidence": 1.0, "hints": ["병원"]},
]


FAR = "".join(chr(0xAC00 + 371 * i) for i in range(3, 29)) + "0123456789"


def test_corrector_applies_rules_in_order():
    c = rules.Corrector(RULES)
    assert c("쌈전도 검사")[0] == "심전도 검사" and c("쌈전도")[0] == "쌈전도" and c("쌈전도" + FAR + "검사")[0] == "쌈전도" + FAR + "검사"
    assert c("5mg 당료")[0] == "5 mg 당뇨" and c("")[0] == "" and c("  ") == ("  ", [])
    text, log = c("당료병 병원")
    assert text == "당뇨 병 병원" and [x[2] for x in log] == ["2", "5"] and {x[3] for x in log} == {"tier1_dict"}
    assert c("당뇨병")[0] == "당뇨병"
    assert c("네. 네. 네. 네. 네. 아파요")[1][0][2:] == ("hallucination_filter", "hallucination")
    without = rules.Corrector(RULES)
    without.automaton = None
    for t in ("당료 당료병 병원", "쌈전도 검사 당료", "x"):
        assert without(t) == c(t)


def test_exact_fold_equals_plain_loop(spark):
    import random

    rng = random.Random(2)
    made = [{"id": str(i), "wrong": "".join(rng.choice("가나다") for _ in range(rng.randint(1, 3))), "correct": "".join(rng.choice("가나다") for _ in range(rng.randint(0, 3))), "strategy": "exact", "hints": rng.choice([[], ["나"], ["다다"]]), "pattern": None, "confidence": 1.0} for i in range(12)]
    for _ in range(300):
        t = "".join(rng.choice("가나다 ") for _ in range(rng.randint(0, 90)))
        want = t
        for r in made:
            at = want.find(r["wrong"])
            if at >= 0 and (not r["hints"] or any(h in want[max(0, at - 30) : at + 30] for h in r["hints"])):
                want = want.replace(r["wrong"], r["correct"])
        assert rules.Corrector(made, ("exact",), clean=False)(t)[0] == (want if t.strip() else t)


def test_long_repeats_are_found_in_long_texts():
    import re

    phrase = "가나다라마바사아자차카타파하"
    for k in (8, 300):
        t = "시작 " * k + phrase * 3 + " 끝" * k
        log = []
        want = t
        while m := re.search(r"(.{10,}?)\1{2,}", want):
            want = want[: m.start()] + m[1] + want[m.end() :]
        while m := re.search(r"(.{2,9}?)\1{2,}", want):
            want = want[: m.start()] + m[1] + want[m.end() :]
        assert C.without_phrases_again(t, 3, log) == want and log
    import time

    began = time.time()
    C.without_phrases_again("".join(chr(0xAC00 + (i * i * 7919) % 11000) for i in range(200_000)), 3, [])
    assert time.time() - began < 30


def test_second_tier(spark):
    texts = spark.createDataFrame([(1, "쌈전도를 쌈전도를 봅니다"), (2, None), (3, ""), (4, "심전도는 정상")], "k int, t string")
    found = spark.createDataFrame([("쌈전도를", "심전도", "c", 0.9, "replace"), ("봅니다", "봄니다", "c", 0.75, "review"), ("정상", "장상", "c", 0.5, "ignore")], "word string, term string, specialty string, similarity double, action string")
    got = {r.k: r for r in D.applied(texts, found, ["k"], "t").collect()}
    assert (got[1].text, got[1].replaced, got[1].pending) == ("심전도 심전도 봅니다", 1, 1) and got[2].text is None and got[4].text == "심전도는 정상"
    assert [l.rule for l in got[1].logs] == ["auto_0.90", "review_0.75"]


def test_misheard_and_queue(spark):
    words = spark.createDataFrame([("쌈전도",), ("쌈전도를",), ("심전도",), ("심전도는",), ("컵",), (None,)], "word string")
    vocabulary = spark.createDataFrame([("심전도", "c"), (None, None)], "term string, specialty string")
    known = spark.createDataFrame([], "wrong string, correct string")
    found = D.misheard(words, vocabulary, known, ["를", "는"], safe=[])
    assert [(r.word, r.term, r.action) for r in found.collect()] == [("쌈전도", "심전도", "review")]  # with its particle it is too far from the term
    queue = D.queued(spark.createDataFrame([], "word string, term string, similarity double, status string"), found)
    assert D.queued(queue, found).count() == 1
    assert D.decided(queue, queue.withColumn("status", F.lit("approved"))).first().status == "approved"


def test_bigram_scores_against_counts(spark):
    texts = [(1, "a b a b"), (2, "a c"), (3, "x"), (4, None), (5, ""), (6, "new a b")]
    df = spark.createDataFrame(texts, "k int, text string")
    model = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, "x"), (4, None)], "k int, text string")
    got = {r.k: r.score for r in D.bigram_scores(df, model, ["k"]).collect()}
    one, two = {}, {}
    for t in ("a b a b", "a c", "x"):
        w = t.split()
        for x in w:
            one[x] = one.get(x, 0) + 1
        for p in zip(w, w[1:]):
            two[p] = two.get(p, 0) + 1
    p = lambda a, b: math.log((two.get((a, b), 0) + 1) / (one[a] + len(one))) if a in one else math.log(1 / (len(one) + 1))
    assert set(got) == {1, 2, 3, 5, 6} and got[3] == got[5] == 0.0
    for k, t in texts:
        if k in got and len((t or "").split()) > 1:
            w = t.split()
            assert math.isclose(got[k], sum(p(a, b) for a, b in zip(w, w[1:])) / len(w), abs_tol=1e-5)


def test_rule_tables(spark):
    r = spark.createDataFrame([("1", "a", "b", 50), ("2", "c", "d", 60)], "id string, wrong string, correct string, priority int")
    up = {x.id: x for x in rules.upserted(r, spark.createDataFrame([("1", None, 70), ("3", "e", 1)], "id string, wrong string, priority int")).collect()}
    assert (up["1"].wrong, up["1"].priority, up["3"].wrong) == ("a", 70, "e")
    assert [x.id for x in rules.deleted(r, r.where("id = '1'")).collect()] == ["2"]
    c = spark.createDataFrame([("x1", "x"), ("new", "other"), ("a", "zzz"), ("same", "same")], "wrong string, correct string")
    assert [(x.wrong, x.priority) for x in rules.learnable(c, r).collect()] == [("new", 53)]


def test_similar_words_lose_no_pair(spark):
    import random

    from turnmill.operators.joins import similar_words

    rng = random.Random(7)
    syllables = "가각나낙다달라마막바사아안자차카타파하허히"
    make = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    words, terms = {make() for _ in range(150)}, {make() for _ in range(150)}
    got = {(r.word, r.term) for r in similar_words(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string"), top=10_000).collect()}
    want = {(w, t) for w in words for t in terms if len(w) >= 2 and abs(len(w) - len(t)) <= max(len(w) // 2, 2) and rules.likeness(rules.letters(w), rules.letters(t)) >= 0.6}
    assert got == want and len(want) > 200

import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions import audio, cleaning, metrics
from turnmill.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("word,value", [("십이", 12), ("이백오", 205), ("만", 10000), ("십만", 100000), ("영", None), ("삼x", None), ("", None), ("이천삼백사십오", 2345)])
def test_sino_numbers(spark, word, value):
    assert one(spark, word, T.sino_number) == value


def test_text_functions(spark):
    assert one(spark, "관절a", T.jamo) == "ㄱㅘㄴㅈㅓㄹa"
    assert one(spark, "네. 네. 가요.", cleaning.without_repeated_sentences) == "네. 가요."
    assert one(spark, "환자에서", lambda c: T.without_particle(c, ["에서"])) == "환자"
    assert one(spark, "가나,다  라 .. 마", cleaning.punctuation) == "가나, 다  라. 마."
    assert one(spark, None, T.jamo) is None and one(spark, None, T.n5) is None
    assert one(spark, "가 a", T.n1) == "가 a"


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, p = [i] + [0] * len(b), d
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def test_alignment(monkeypatch):
    rng = random.Random(1)
    for cells in (4_000_000, 12):
        monkeypatch.setattr(metrics, "MOST_CELLS", cells)
        for _ in range(150):
            a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in "xy")
            ops = metrics.align(a, b)
            assert sum(o != "C" for o, _, _ in ops) == distance(a, b)
            assert [r for o, r, _ in ops if o != "I"] == a and [h for o, _, h in ops if o != "D"] == b


def test_word_errors(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), (None, "a"), ("", "")], "r string, h string")
    got = [r.x and (r.x.distance, r.x.substitutions, r.x.deletions, r.x.insertions) for r in df.select(metrics.word_errors(F.col("r"), F.col("h")).alias("x")).collect()]
    assert got[0] == (2, 1, 0, 1) and got[1] == (1, 0, 0, 1) and got[3] == (0, 0, 0, 0)


def test_error_rate_cases(spark):
    df = spark.createDataFrame([("가나", "가"), ("", ""), ("", "가"), ("가", "가나다라")], "r string, h string")
    assert [r[0] for r in df.select(metrics.character_error_rate(F.col("r"), F.col("h"))).collect()] == [0.5, 0.0, 1.0, 3.0]
    assert df.select(metrics.character_error_rate(F.col("r"), F.col("h"), capped=True)).collect()[3][0] == 1.0


def test_normal_forms(spark):
    assert one(spark, "a_b@c/d%", T.n5) == "abcd" and one(spark, "CT(씨티) 검사, (MRI) 좋아요!", T.n5) == "씨티검사좋아요"
    assert one(spark, "음 검사를 합니다. 아프거든요", T.n6) == "검사를해아프거든" and one(spark, "음식 그래요", T.n6) == "음식그래"
    assert one(spark, "insulin(인슐린) 맞음.", T.n4) == "인슐린 맞음" and one(spark, "a-b…c", T.n2_words, "string") == ["a", "b", "c"]


def test_alignment_prefers_as_told():
    # equally short: two changes, or a deletion and an insertion with one match between them
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 7))] for _ in "xy")
        for first in (False, True):
            ops = metrics.align(a, b, first)
            assert sum(o != "C" for o, *_ in ops) == distance(a, b)
            want, i, j = [], len(a), len(b)
            d = [[distance(a[:x], b[:y]) for y in range(len(b) + 1)] for x in range(len(a) + 1)]
            while i or j:
                up, left = i and d[i][j] == d[i - 1][j] + 1, j and d[i][j] == d[i][j - 1] + 1
                if i and j and a[i - 1] == b[j - 1]:
                    op, i, j = "C", i - 1, j - 1
                elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
                    op, i, j = "S", i - 1, j - 1
                elif left and (first or not up):
                    op, j = "I", j - 1
                else:
                    op, i = "D", i - 1
                want.append(op)
            assert [o for o, *_ in ops] == want[::-1]


def test_signal_to_noise_by_thirds(spark):
    rng = random.Random(1)
    for n in (10, 11, 12, 17):
        x = [rng.uniform(-1, 1) for _ in range(4 * n + 2)]
        e = sorted(max(sum(v * v for v in x[4 * i : 4 * i + 4]) / 4, 1e-10) for i in range(n))
        low, high = e[: n // 3], e[2 * n // 3 :]
        import math

        want = round(10 * math.log10((sum(high) / len(high)) / (sum(low) / len(low))), 1)
        assert abs(one(spark, x, lambda c: audio.signal_to_noise(c, 4), "array<double>") - want) < 0.051
    assert one(spark, [0.5, -0.25, 0.3333], audio.peak_normalised, "array<double>") == [int(v * (10 ** (-3 / 20) / 0.5) * 32767) for v in (0.5, -0.25, 0.3333)]
    assert one(spark, [1e-8] * 16, lambda c: audio.compressed(c, 16), "array<double>") == [1e-8] * 16


def test_signals(spark):
    x = [0.0] * 40 + [0.5] * 40
    assert one(spark, x, lambda c: audio.signal_to_noise(c, 4), "array<float>") > 25
    assert one(spark, [0.1] * 8, lambda c: audio.signal_to_noise(c, 4), "array<float>") == 30.0
    assert max(one(spark, [0.1, -0.2], audio.peak_normalised, "array<float>"), key=abs) in (23197, -23197, -23198)
    assert one(spark, [0.0, 0.0], audio.loudness_normalised, "array<float>") == [0.0, 0.0]

"""Registered queries do the whole job: no row, text or stage is left out."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnmill.functions import cleaning as C

SEGMENT = "row_id long, file_id string, seq int, start double, end double, text string, speaker string, confidence double"


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return entry.queries()[name](spark, str(folder))


def test_j1_looks_up_every_segment_in_every_turn(spark, tmp_path):
    who = ["A", "A", "B", "A", "B", "B", "C", "C", "A"]
    data = [(i, "f", i, 10.0 * i, 10.0 * i + 9.9, "t", w, 1.0) for i, w in enumerate(who, 1)]
    data += [(90, "f", 10, None, None, "t", "A", 1.0), (91, "f", 11, 31.0, 31.5, "t", "D", 1.0)]
    got = {r.seq: r.speaker for r in run(spark, tmp_path, "j1_interval_speaker", transcribe_segments=(data, SEGMENT)).collect()}
    # the short segment 11 lies within the turn of segment 3, which comes first
    assert got == {**dict(enumerate(who, 1)), 10: None, 11: "B"}


RESULT = "result_id long, run_id long, model_key string, type int, source string, cer double, ref_len int, hyp_len int, ratio double, duration_s double, elapsed_s double, truncated boolean, reference string, hypothesis string"


def results(model, texts, cer=None):
    return [(i, 1, model, 1, "s", cer(i) if cer else 0.0, 1, 1, 1.0, 1.0, 1.0, False, a, b) for i, (a, b) in enumerate(texts, 1)]


def test_s8_sorts_all_results(spark, tmp_path):
    a = results("jangmin", [("x", "x")] * 150, lambda i: None if i == 7 else float((i * 37) % 101))
    b = results("seastar105", [("x", "x")] * 30, lambda i: float(i))
    got = [(r.cer, r.result_id) for r in run(spark, tmp_path, "s8_best_results", jangmin_result_no_prompt=(a, RESULT), seastar105_result_no_prompt=(b, RESULT)).collect()]
    assert got == sorted((r[5], r[0]) for r in a + b if r[5] is not None) and len(got) == 179


def test_h3_returns_every_result_with_many_errors(spark, tmp_path):
    texts = [("가 나 다 라", "가 나 다 마")] * 2 + [("가 나, 다!", "가 나 다")] + [("가 나 다 라", "가 라")] * 40 + [("가", None), (None, None), ("", "가"), ("", "."), ("가 나 다 라 마 바 사 아 자 차", "가 나 다 라 마 바 사 하 하 하")]
    a, b = results("jangmin", texts), results("seastar105", texts[:5], lambda i: None)
    got = run(spark, tmp_path, "h3_worst_results", jangmin_result_no_prompt=(a, RESULT), seastar105_result_no_prompt=(b, RESULT)).collect()
    assert sorted((r.model_key, r.result_id) for r in got) == [("jangmin", i) for i in [*range(4, 45), 46]] + [("seastar105", 4), ("seastar105", 5)]
    assert {(r.reference, r.hypothesis, r.wer) for r in got} == {("가 나 다 라", "가 라", 0.5), ("가", None, 1.0), ("", "가", 1.0)}


def test_t24_returns_whole_texts(spark, tmp_path):
    texts = ["가" * 500, "a\x00b" + "c" * 80, "", None, "짧은 글"]
    data = [(i, "f", i, 0.0, 1.0, t, "A", 1.0) for i, t in enumerate(texts)]
    got = {r.seq: r.text for r in run(spark, tmp_path, "t24_sanitised", transcribe_segments=(data, SEGMENT)).collect()}
    assert got == {0: texts[0], 1: "ab" + "c" * 80, 2: "", 4: "짧은 글"}


def test_surrogates_are_joined_or_replaced(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xed\xa0\x80b"),), (bytearray(b"\xed\xa0\xbd\xed\xb8\x80"),), (bytearray(b"x\xff" + b"y" * 90),)], "b binary")
    got = [r[0] for r in raw.select(C.sanitised(F.col("b").cast("string"))).collect()]
    assert got == ["a\ufffdb", "\U0001f600", "x\ufffd" + "y" * 90]


RULE = "id string, wrong string, correct string, category string, strategy string, pattern string, context_hint array<string>, priority int, confidence double, enabled boolean, notes string"


def test_t18_has_all_stages(spark, tmp_path):
    cases = [
        ("아파요 아파요 아파요 아파요 많이", "아파요 많이."),
        ("혈압이 높아요. 시청해 주셔서 감사합니다!", "혈압이 높아요."),
        ("[음악] 네 ,좋아요", "네, 좋아요."),
        ("감사합니다. 감사합니다.", ""),
        ("...", ""),
        ("가누졸젱 두 알 드세요", "가누졸정 2알 드세요?"),
        ("두통에 쌈전도를 보죠", "두통에 심전도를 보죠."),
        ("씨티이 찍어요", "CT 찍어요?"),
        ("소변에서 심장 기능이 나빠요", "소변에서 신장 기능이 나빠요."),
        ("진로 의뢰서요", "진료 의뢰서요."),
        ("13월부터. 14월부터. 약을 드세요", "약을 드세요?"),
        ("배가 아파요. 배가 아파요. 그래요", "배가 아파요. 그래요."),
        ("가나다라마바사아자차가나다라마바사아자차", "가나다라마바사아자차."),
    ]
    data = [(i, "f", i, 0.0, 1.0, t, "A", 1.0) for i, (t, _) in enumerate(cases)]
    rule = [("1", "가누졸젱", "가누졸정", "c", "exact", None, [], 50, 0.9, True, None), ("2", "썸전도", "심전도", "c", "phonetic", None, ["두통"], 50, 0.8, True, None), ("3", "씨티", "CT", "c", "regex", "씨티이?", [], 50, 0.9, True, None)]
    got = {r.seq: r.text for r in run(spark, tmp_path, "t18_polished", transcribe_segments=(data, SEGMENT), medical_dict_entries=(rule, RULE)).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]

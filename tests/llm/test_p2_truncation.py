import random

import numpy as np

from turnmill.llm import truncation as T

SCHEMA = "model_key string, result_id bigint, source string, text string, reference string, hyp_len int, chars string"


def test_remnants():
    assert all(T.broken(t) for t in ("가&am", "가\\u00", "가=EC=9", "가�", "말ㅆ"))
    assert not any(T.broken(t) for t in ("가요.", "CT", "39.1도", "가요…"))


def test_artificial_cuts_are_heads():
    rng = np.random.default_rng(1)
    for _ in range(200):
        head = T.artificial("오늘은 검사를 먼저 하고 다시 뵙겠습니다. 네, 좋습니다.", [20], rng)
        assert head is None or not head.endswith(".") or head.endswith("...")


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    nouns, verbs = ["혈압이", "복통이", "검사를", "약을", "수술을", "기침이"], ["먼저 하고 다시 뵙겠습니다.", "조금 나아졌어요.", "하루 두 번 드시면 됩니다.", "언제부터 있으셨어요?"]
    say = lambda: " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(rng.randint(1, 5)))
    rows, cut = [], set()
    for i in range(3000):
        t = say()
        whole = len(t.replace(" ", ""))
        source = rng.choice(["plain", "limit", "wire"])
        if source == "limit" and len(t) > 60:
            if not t[:60].rstrip().endswith((".", "?")):
                cut.add(i)
            t = t[:60]
        if source == "wire" and rng.random() < 0.08:
            k = rng.randint(4, len(t) - 2)
            if not t[:k].rstrip().endswith((".", "?")):
                t, _ = t[:k], cut.add(i)
        if i not in cut and rng.random() < 0.1:
            t = t.rstrip(".")
        rows.append(("m", i, source, t, None, len(t.replace(" ", "")) if source != "limit" else None, "clash"))
    rows += [("m", 9001, None, None, None, None, None), ("m", 9002, "plain", "", "", 0, None), ("m", 9003, "plain", "   ", None, None, None), ("m", 9004, "plain", "가 " * 20000 + "끝.", None, None, None), ("m", 9005, "plain", "검사를 먼저 하고 다시 뵙겠습니다.", None, 99, None)]
    got = {r.result_id for r in T.scored(spark.createDataFrame(rows, SCHEMA), ["model_key", "result_id"]).where("cut").collect()}
    assert 9005 in got and not got & {9001, 9002, 9003}
    got -= {9004, 9005}
    assert len(got & cut) / len(cut) > 0.9 and len(got & cut) / max(1, len(got)) > 0.9


def test_empty(spark):
    assert T.scored(spark.createDataFrame([], SCHEMA), ["model_key", "result_id"]).collect() == []

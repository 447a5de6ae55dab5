import random

import pytest

from turnmill.llm import mojibake as M

CLEAN = [
    "환자분은 귀가 어두우셔서 제가 대신 말씀드릴게요. 체온은 36.7°C입니다.", "다음 진료는 목요일 오전 8시에 잡아 드릴게요. 혈압이 조금 높아요.", "Le patient décrit une fièvre dès le réveil, à midi déjà élevée.",
    "Der Patient klagt über Übelkeit und Hörverlust. Größe unverändert.", "MAÑANA continúa la revisión; não há dor, SÃO 26 comprimidos.", "The second speaker’s label was “wrong” – 10 µg after café-au-lait spots.",
    "Температура 38.0, давление 140", "患者の体温は36.5度、血圧は104/58でした。", "점수 😀→😖 20점 \\ud658\\uc790 &eacute; ½ Tablette ± 26 %", "Café déjà vu",
]
WAYS = {"latin": lambda t: t.encode().decode("latin-1"), "1252": lambda t: "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode()), "mac": lambda t: t.encode().decode("mac_roman"), "twice": lambda t: WAYS["1252"](WAYS["1252"](t))}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    return [(i, rng.choice(CLEAN)) for i in range(800)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, restored string")
    return {r.doc_id: r for r in M.restored(df).collect()}


def test_restores_what_can_be_had(spark, corpus):
    bad = [(1000 + i, w(t), t) for i, (w, t) in enumerate((w, t) for w in WAYS.values() for t in CLEAN[:6])]
    part = CLEAN[0][:20] + WAYS["1252"](CLEAN[0][20:])
    got = run(spark, corpus + [b[:2] for b in bad] + [(1, None), (2, ""), (3, " "), (4, "환자 �� 네"), (5, part), (6, CLEAN[0].encode("cp949").decode("latin-1"))])
    assert not any(got[i].garbled for i, _ in corpus if i > 10)
    for i, _, t in bad:
        assert got[i].garbled and got[i].restored == t
    assert got[5].restored == CLEAN[0] and got[6].restored == CLEAN[0]
    assert (got[1].garbled, got[1].restored, got[2].garbled, got[3].restored) == (False, None, False, " ")
    assert got[4].garbled and got[4].beyond_repair


def test_lost_bytes_are_filled(spark, corpus):
    lost = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else "?" for b in CLEAN[0].encode())
    broken = CLEAN[1].encode().decode("cp949", "replace")
    got = run(spark, corpus + [(1000, lost), (1001, broken), (1002, "é" * 30000), (1003, WAYS["1252"]("가" * 5000))])
    assert got[1000].garbled and got[1000].restored == CLEAN[0]
    assert got[1001].garbled and not got[1002].garbled and got[1003].garbled


def test_empty(spark):
    assert run(spark, []) == {}


def test_marks_that_no_look_at_characters_tells(spark, corpus):
    """UTF-8 read as cp949 makes one syllable of an accented letter and its neighbour; bytes lost from cp949 are filled."""
    french = "Le patient est à la maison, il va à Paris à midi."
    read = french.encode().decode("cp949", "replace")
    rows = corpus + [(2000 + i, french) for i in range(300)] + [(1, read), (2, "le soir 횪 la maison"), (3, "환자분은 귀가 어두우셔서")]
    got = run(spark, rows)
    assert got[1].garbled and not got[3].garbled and not got[2000].garbled


def test_lost_bytes_of_cp949(spark, corpus):
    import numpy as np

    lang = M.Language(np.zeros((M.ROWS, M.BUCKETS), np.int64), {"환": 50, "자": 40, "분": 30})
    b = list("환자".encode("cp949"))
    assert M._as_korean([b[0], None, b[2], b[3]], lang, None) == "환자"
    assert M._as_korean([None, b[1], 0x41], lang, None)[1:] == "A"
    assert M._as_korean([None], lang, None) is None


def test_count_min_rows_differ():
    a = M.buckets("환자")
    assert len(set(a)) == M.ROWS and all(0 <= k < M.BUCKETS for k in a)

import pytest

from turnmill.llm import personal as P

CASES = [
    ("결과지는 a.b9@x-y.example 쪽으로", "결과지는 [EMAIL] 쪽으로"), ("메일은 neul7 골뱅이 maru.mail 점 test 입니다", "메일은 [EMAIL] 입니다"), ("ｄａｌ－７＠ｎｕｒｉ．ｔｅｓｔ", "[EMAIL]"), ("a(at)b[dot]test", "[EMAIL]"),
    ("번호는 ０１０－１２３４－５６７８로", "번호는 [PHONE]로"), ("공일공 공이공육 칠구일이로 전화", "[PHONE]로 전화"), ("(02) 123-4567 팩스", "[PHONE] 팩스"), ("+82 10-1234-5678", "[PHONE]"), ("01012345678", "[PHONE]"), ("010 (웃음) 1234 5678 네", "[PHONE] 네"),
    ("서류에 900101-1234567로", "서류에 [ID_NUMBER]로"), ("여권번호 M12345678 맞아요", "여권번호 [ID_NUMBER] 맞아요"), ("면허번호 12-34-567890-12", "면허번호 [ID_NUMBER]"),
    ("약은 바람결로 346로 택배", "약은 [ADDRESS]로 택배"), ("퇴원하면 새벽별시 나린구 물오름길9길 70-20, 113동 1207호에", "퇴원하면 [ADDRESS]에"), ("해온동 277-25 번지이에요", "[ADDRESS]이에요"), ("47 Yunseul-ro 4-gil, Neulon-gu, Gaonbit City로", "[ADDRESS]로"),
    ("제 이름은 김온비이고", "제 이름은 [NAME]이고"), ("대기 중이신 남궁 달솜 님", "대기 중이신 [NAME] 님"), ("어제 Yi Haeseul 씨가", "어제 [NAME] 씨가"),
    ("담당 교수님이랑 간호사님 성함은 모르겠어요.", None), ("성함이 어떻게 되세요?", None), ("검체 번호 2025-042-77은", None), ("바코드 9988001234520 다시", None), ("접수번호 240319-0018번 환자분", None), ("로트 010-4-A 제품", None),
    ("3층 3023호실 2동 병동으로", None), ("Sjögren 증후군 검사", None), ("혈압 120/80, 체온 36.5도", None), ("이 환자분은 주민번호 앞자리만", None), ("정 2정 @ 오후 9시", None), ("", None), ("  ", None), ("[00:08:38] 네", None), ("25mg으로 3일치 드릴게요", None),
]


@pytest.mark.parametrize("text,out", CASES)
def test_redaction(text, out):
    assert P.redact(text) == (text if out is None else out)


def test_spans_map_back():
    text = "음, ＡＢ​Ｃ@x.test 그리고 010​-1234-5678 입니다"
    assert [text[s:e] for s, e, _ in P.find(text)] == ["ＡＢ​Ｃ@x.test", "010​-1234-5678"]


def test_long_text():
    assert P.redact("가나다 " * 20000 + "a@b.test") == "가나다 " * 20000 + "[EMAIL]"
    assert P.find("가" * 50000) == [] and P.find("1" * 50000) == [] and P.find("a" * 50000 + "@") == []


def test_tables(spark):
    rows = [("f", 1, t, "clash") for t, _ in CASES] + [("f", 2, None, None), ("g", 1, "a@b.test 01012345678", None), ("g", 1, "a@b.test 01012345678", None)]
    df = spark.createDataFrame(rows, "file_id string, seq int, text string, kind string")
    got = [tuple(r) for r in P.kinds(df, "text", ["file_id", "seq"]).distinct().collect()]
    assert {("g", 1, "email"), ("g", 1, "phone")} == {r for r in got if r[0] == "g"} and {k for f, _, k in got if f == "f"} == set(P.PLACEHOLDER)
    out = P.redacted(df, "text").collect()
    assert [r.text for r in out[: len(CASES)]] == [t if o is None else o for t, o in CASES] and out[len(CASES)].text is None
    assert P.kinds(df.limit(0), "text", ["file_id"]).collect() == []


# Words around which random texts are made: every detector, disguise, noise and cue, and pieces of them.
PIECES = [
    "maru7", "nuri", "test", "a.b9", "x-y", "@", "＠", " 앳 ", "(AT)", " ( at ) ", "[ at ]", " 골뱅이 ", "골", "뱅이", "(dot)", " [ dot ] ", " 점 ", ".", "공일공", "공이", " 일이삼사", " 오육칠팔", "공영일", "010", "02", "(02)", "+82 10", "1234", "5678", "900101", "1234567", "-", " - ", " ",
    "\t", "M12345678", "M123A4567", "12-34-567890-12", "새빛길", "바람결로", "물오름대로", "9번길", "12", "70-20", "해온동", "번지", "산", "47", ", ", "Yunseul-ro", "Gaonbit City", "113동", "1207호", "김온비", "남궁", "달솜", "선우", "Kim", "Haeseul", "KIM", "HAESEUL", "님", "씨", "환자", "보호자", "어르신", "분",
    "이름", "성함은", "성명:", "존함", "동의서", "명단에는", "담당은", "담당의는", "name is", "Name:", "I am", "this is", "입니다", "이에요", "에", "로", "쪽", "(웃음)", "[noise]", "((기침))", "음...", "어…", "그,", "으흠,", "♪", "​", "\xad", "　", "０１０", "１２３４", "ａｂ", "—", "…", ",", "?", "!", "\x1c", "\n", "\x7f", "é", "ㄱ", "각",
]


def texts_of_pieces(n, seed):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_no_find_escapes_the_filter(spark):
    import regex
    from pyspark.sql import functions as F

    texts = texts_of_pieces(40000, 5) + [t for t, _ in CASES]
    found = [t for t in texts if P.find(t)]
    assert len(found) > 4000 and {k for t in found for _, _, k in P.find(t)} == set(P.PLACEHOLDER)
    here = regex.compile(P.SUSPECT)
    assert [t for t in found if not here.search(t)] == []
    df = spark.createDataFrame([(t,) for t in found], "t string")
    assert df.where(~P.suspect(F.col("t"))).collect() == []


def test_forms_that_a_filter_lost_before():
    for t, k in [("maru7 앳 nuri.test", "email"), ("maru7 (AT) nuri.test", "email"), ("maru7 ( at ) nuri.test", "email"), ("maru7 [ at ] nuri [ dot ] test", "email"), ("공이 일이삼사 오육칠팔", "phone"), ("새빛길\t12", "address"), ("김온비 (웃음) 님", "name"), ("152, Teheran-ro", "address"), ("김온비님", "name")]:
        assert [x for *_, x in P.find(t)] == [k] and P.regex.search(P.SUSPECT, t)


#: Notations of own invention, apart from those of the detectors' cases: text, kinds in it.
OTHERS = [
    ("My name is Kim Haeseul.", ["name"]), ("담당은 김온비", ["name"]), ("담당의는 박하늘입니다", ["name"]), ("KIM HAESEUL 님 들어오세요", ["name"]), ("성함: 이노을, 생년월일은", ["name"]), ("이노을 씨 계세요?", ["name"]), ("제 이름이 최바다예요", ["name"]),
    ("김온비입니다", ["name"]), ("저 김온비라고 합니다", ["name"]), ("환자 이노을, 45세", ["name"]), ("saebyeok.k@dal-bit.example.org 로요", ["email"]), ("메일 mail7@star.test, 전화 031.222.3344", ["email", "phone"]), ("hana_2 at bom dot test", ["email"]), ("전화는 공일공에 삼사오육에 칠팔구공", ["phone"]), ("010.9876.5432", ["phone"]), ("+82-2-345-6789", ["phone"]), ("tel:0317778888", ["phone"]),
    ("주민번호 851212 2345678", ["id_number"]), ("여권 M123A4567", ["id_number"]), ("면허 11-22-333333-44", ["id_number"]), ("가람시 노을구 달빛로 77, 3층으로", ["address"]), ("은하동 산 12-3번지", ["address"]), ("12 Haneul-daero, Byeol-gu", ["address"]), ("노을길 8로 보내 주세요", ["address"]),
    ("김치를 드세요", []), ("정상입니다", []), ("고혈압입니다", []), ("담당은 신경외과입니다", []), ("선생님 안녕하세요", []), ("3층 12호 병동", []), ("검사 번호 20240101-1234567", []), ("5 대 1 비율", []), ("체중 70.5 키 170", []), ("I am fine.", []), ("name is missing", []), ("이름은 모르겠어요.", []), ("오후 3시 30분", []), ("120에 80", []), ("유방암 씨티 촬영", []), ("@ 표시", []),
]


def test_recall_and_precision_off_the_templates():
    true = [(t, k) for t, ks in OTHERS for k in ks]
    found = [(t, k) for t, _ in OTHERS for *_, k in P.find(t)]
    both = set(true) & set(found)
    assert len(both) / len(true) >= 0.7 and len(both) / len(found) >= 0.9

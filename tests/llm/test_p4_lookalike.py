import unicodedata

from turnmill.llm import lookalike as K

SCHEMA = "result_id bigint, reference string, hypothesis string, c string, n int"
PAIRS = [
    ("ＣＴ 검사", "CT 검사", True), ("Ménière", "Ménière", True), (unicodedata.normalize("NFD", "한글"), "한글", True), ("СТ", "CT", True), ("Ｃ​Т", "CT", True),
    ("가 나", "가 나", True), ("5㎎", "5mg", True), ("나…", "나...", True), ("하\u11ab", "한", True), ("﻿가⁠", "가", True), ("Ⅱ", "II", True),
    ("CT", "ct", False), ("é", "e", False), ("1", "2", False), ("가.", "가", False), ("가 나", "가나", False), ("a–b", "a-b", False), ("가", None, False), (None, None, False), ("", "", False), ("같다", "같다", False),
]


def test_pairs(spark):
    rows = [(i, a, b, "clash", 1) for i, (a, b, _) in enumerate(PAIRS)] + [(99, "한" * 30000, "한" * 30000, None, None), (100, "Ａ" * 30000, "A" * 30000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.result_id for r in K.alike_but_different(df, "reference", "hypothesis", ["result_id"]).collect()}
    assert got == {i for i, (_, _, same) in enumerate(PAIRS) if same} | {100}


def test_form_is_stable(spark):
    df = spark.createDataFrame([(i, a, b, "x", 1) for i, (a, b, _) in enumerate(PAIRS)], SCHEMA)
    once = K.consistent(df, ["reference", "hypothesis"]).orderBy("result_id").collect()
    twice = K.consistent(spark.createDataFrame(once, SCHEMA), ["reference", "hypothesis"]).orderBy("result_id").collect()
    assert once == twice and all(r.c == "x" for r in once)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert K.alike_but_different(df, "reference", "hypothesis", ["result_id"]).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert K.consistent(nulls, ["reference"]).first().reference is None


#: Pairs apart from those above: what looks alike, and what doesn't, over several scripts.
ALIKE = [
    ("ρ", "p"), ("α", "a"), ("ɑ", "a"), ("Ꭺ", "A"), ("ո", "n"), ("ѵ", "v"), ("ϲ", "c"), ("ӏ", "l"), ("ǃ", "!"), ("Ѐ", "È"), ("ӧ", "ö"), ("〜", "~"), ("∼", "~"), ("Ѐ", "È"), ("ӧ", "ö"), ("ế", "ế"), ("ế", "ế"), ("ｶﾞ", "ガ"), ("Å", "Å"), ("ﬁ", "fi"), ("ﬃ", "ffi"), ("fﬁ", "ffi"), ("ﬀi", "ffi"),
    ("№", "No"), ("㎜", "mm"), ("℃", "°C"), ("ⅷ", "viii"), ("Ωμ", "Ωµ"), ("한", "한"), ("한", "한"), ("ﾊﾝ", "ハン"), ("한", "하​ᆫ"), ("Ｋ", "K"), ("К", "K"), ("Κ", "K"), ("a­b", "ab"), ("a b", "a b"), ("Ạ́", "Ạ́"), ("Ꮪ", "S"), ("օ", "o"), ("Ѕ", "S"), ("’", "'"), ("“", '"'),
]
APART = [("é", "è"), ("A", "a"), ("n", "ñ"), ("1", "l"), ("O", "0"), ("²", "2"), ("½", "1/2"), ("①", "1"), ("가", "각"), ("-", "—"), (".", ","), ("β", "ß"), ("ö", "o"), ("ㄱ", "가"), ("、", ",")]


def test_pairs_of_many_scripts():
    from collections import Counter

    def form_of(texts):
        f = Counter()
        for t in texts:
            f.update(t)
            f.update(u for u in K._UNIT.findall(t))
            f.update({u: 0 for u in K._UNIT.findall(t.translate(K._Alone()))})
        return K.Rewriter({k: n for k, n in f.items() if len(k) == 1 or K._UNIT.fullmatch(k)})

    everything = form_of([x for p in ALIKE + APART for x in p])
    found = [p for p in ALIKE if everything(p[0]) == everything(p[1])]
    assert [p for p in ALIKE if p not in found] == []
    assert [p for p in APART if everything(p[0]) == everything(p[1])] == []
    for p in ALIKE:  # the same in a corpus that holds nothing else
        alone = form_of(p)
        assert alone(p[0]) == alone(p[1]), p


def test_the_most_frequent_member_represents(spark):
    rows = [(i, "5㎎ Ｃ", None, "x", 1) for i in range(30)] + [(99, "5mg C", "5㎎ С", "x", 1)]
    got = {r.reference for r in K.consistent(spark.createDataFrame(rows, SCHEMA), ["reference", "hypothesis"]).collect()}
    assert got == {"5㎎ Ｃ"}

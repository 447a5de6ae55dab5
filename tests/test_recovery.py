import json

import pyarrow as pa
from pyspark.sql import functions as F

from turnmill.operators import recovery as V
from turnmill.operators import roles, rules
from turnmill.sources import dictionary as D
from turnmill.sources import sinks
from turnmill.sources import transcripts as X

SEG = "file_id string, seq int, start double, end double, text string"


def test_gaps_are_heard_again(spark):
    asked = []

    def hear(batches):
        for b in batches:
            d = b.to_pydict()
            rows = [(f, g, 0.7, 1.5, " 말씀 ") for f, g in zip(d["file_id"], d["gap_start"]) if g > 1] + [(f, g, 0.0, 0.1, "x") for f, g in zip(d["file_id"], d["gap_start"])]
            yield pa.RecordBatch.from_pylist([dict(zip(("file_id", "gap_start", "start", "end", "text"), r)) for r in rows], pa.schema([("file_id", pa.string()), ("gap_start", pa.float64()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))

    gaps = spark.createDataFrame([("f", 0.2, 3.0), ("f", 10.0, 14.0)], "file_id string, gap_start double, gap_end double")
    found = V.tried_again(gaps, hear)
    assert [tuple(r) for r in found.collect()] == [("f", 10.0, 10.2, 11.0, "말씀")] and not asked
    seg = spark.createDataFrame([("f", 1, 3.0, 10.0, "a"), ("f", 2, 14.0, 15.0, "b"), ("f", 3, None, None, "c")], SEG)
    assert sorted((r.seq, r.start) for r in V.merged(seg, found).where("start is not null").collect()) == [(-1, 10.2), (1, 3.0), (2, 14.0)]
    assert V.merged(seg, found).count() == 4
    assert tuple(V.counters(gaps, found).first()) == ("f", 2, 1, 1)


def test_second_recognition_must_be_long_enough(spark):
    df = spark.createDataFrame([(1, "abcdef", 0.4, "abc"), (2, "abcdef", 0.4, "ab"), (3, "abcdef", 0.0, "abcdef1"), (4, "abcdef", None, "x" * 9), (5, None, 0.1, "ab"), (6, "a", 0.2, None)], "k int, text string, confidence double, again string")
    got = {r.k: (r.text, r.retried) for r in V.retried(df, F.col("again")).collect()}
    assert got == {1: ("abc", True), 2: ("abcdef", False), 3: ("abcdef", False), 4: ("abcdef", False), 5: ("ab", True), 6: ("a", False)}


def test_only_the_first_low_rows_are_revised(spark):
    df = spark.createDataFrame([("f", i, f"t{i}", 0.1 if i % 2 else 0.9) for i in range(60)], "file_id string, seq int, text string, confidence double")
    got = [r.seq for r in V.revised(df, F.upper("text")).where("revised").collect()]
    assert sorted(got) == list(range(1, 30, 2))


def test_prompt_tails(spark):
    df = spark.createDataFrame([("f", i, 60.0 * i + 1, 60.0 * i + 2, f"가나다라{i:03d}") for i in range(90)] + [("f", 900, None, None, "x"), ("f", 901, 5.0, 6.0, " ")], SEG)
    got = {r.chunk: r.tail for r in V.prompt_tails(df).collect()}
    for k in range(90):
        assert got[k] == " ".join(f"가나다라{i:03d}" for i in range(k))[-400:]


def test_mentions(spark):
    t = spark.createDataFrame([(1, "심전도와 심장 심전도"), (2, None), (3, ""), (4, "심")], "k int, text string")
    v = spark.createDataFrame([("심전도",), ("심장",), ("심",), (None,), ("위",)], "term string")
    assert sorted((r.k, r.term, r.at) for r in V.mentions(t, v, ["k"]).collect()) == [(1, "심장", 6), (1, "심전도", 1)]


def test_rules_meet_texts_by_pieces(spark):
    r = spark.createDataFrame([("가", [], True), ("가나", ["힌트"], True), ("나다", None, True), ("라", [], False), ("", [], True), (None, [], True)], "wrong string, context_hint array<string>, enabled boolean")
    t = spark.createDataFrame([(1, "가나다"), (2, "가나 힌트"), (3, None), (4, ""), (5, "라")], "k int, text string")
    assert {x.k: x.rules for x in rules.matches(t, r, ["k"]).collect()} == {1: 2, 2: 2, 4: 0, 5: 0}


def test_model_answers_are_taken_for_enough_rows(spark):
    df = spark.createDataFrame([("f", i, i, f"t{i}", None) for i in range(1, 11)] + [("g", i, i, f"t{i}", "doctor") for i in range(1, 11)], "file_id string, seq int, place bigint, text string, role string")
    a = spark.createDataFrame([("f", i, f" n{i} ", "doctor" if i % 2 else "king") for i in range(1, 7)] + [("g", i, f"n{i}", "patient") for i in range(1, 6)] + [("f", 0, "x", "doctor"), ("f", 9, "  ", "doctor")], "file_id string, place bigint, text string, role string")
    got = {(r.file_id, r.seq): (r.text, r.role) for r in roles.reattached(df, a).collect()}
    assert got["f", 1] == ("n1", "doctor") and got["f", 2] == ("n2", None) and got["f", 9] == ("t9", None) and all(got["g", i] == (f"t{i}", "doctor") for i in range(1, 11))


def test_speakers_of_a_file(spark):
    df = spark.createDataFrame(
        [("one", 1, "x", "네"), ("two", 1, "a", "배가 아파요"), ("two", 2, "b", "수술 하셔야 합니다. 처방 드릴게요"), ("many", 1, "a", "가"), ("many", 2, "b", "가나다라"), ("many", 3, "c", "가나다라"), ("null", 1, None, None), ("tie", 1, "a", "가나다라 마바 사아"), ("tie", 2, "b", "가나다라 마바 사아")],
        "file_id string, seq int, speaker string, text string",
    )
    got = {(r.file_id, r.speaker): r.role for r in roles.speaker_roles(df).collect()}
    assert got["one", "x"] == "doctor" and got["two", "b"] == "doctor" and got["two", "a"] == "patient" and got["many", "b"] == "doctor" and got["many", "c"] == "patient" and got["null", ""] == "doctor"
    assert got["tie", "b"] == "doctor" and got["tie", "a"] == "patient"


def test_documents_and_queues(spark, tmp_path):
    r = spark.createDataFrame([("1", "a", "b", "c", "exact", None, ["h1", "h2"], 50, 1.0, True, None)], D.ENTRY)
    D.write_document(r, str(tmp_path / "doc"))
    assert [tuple(x)[:3] for x in D.read_document(spark, str(tmp_path / "doc")).collect()] == [("1", "a", "b")]
    raw = json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])
    assert raw["updated_at"].endswith("Z") and raw["entries"][0]["context_hint"] == ["h1", "h2"]
    D.write_csv(r.drop("id"), str(tmp_path / "csv"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0].lstrip("\ufeff").startswith("wrong,correct") and "h1|h2" in lines[1]
    both = D.imported(r, spark.createDataFrame([("x", "y")], "wrong string, correct string")).collect()
    assert len(both) == 2 and both[1].priority == 50 and both[1].id
    q = spark.createDataFrame([("1", "w", "t", 0.7, "c" * 300, "s", "pending", "2024-01-01T00:00:00+00:00")], D.REVIEW)
    D.write_reviews(q, str(tmp_path / "q"))
    got = D.read_reviews(spark, str(tmp_path / "q")).first()
    assert len(got.context_sentence) == 200 and got.created_at.year == 2024
    v = spark.createDataFrame([(json.dumps({"specialties": {"s": {"terms": ["a", "b"], "keywords": ["k"]}}}),), ("{broken",), (None,)], "raw string")
    assert sorted(map(tuple, D.vocabulary(v, "raw").collect())) == [("s", "a"), ("s", "b")]


def test_texts_and_responses(spark, tmp_path):
    (tmp_path / "type1").mkdir()
    (tmp_path / "type1" / "type1_full_transcript.txt").write_text("\n 가나\n다 \n", encoding="utf-8")
    got = X.read_texts(spark, str(tmp_path), spark.createDataFrame([(1,), (2,)], "type_num int")).orderBy("type_num").collect()
    assert [tuple(r) for r in got] == [(1, "가나\n다", False), (2, None, True)]
    raw = [(1, json.dumps({"segments": [{"start": 1500, "end": 2000, "text": "네", "confidence": 0.9, "speaker": {"label": "2"}}, {"start": 1, "end": 2, "text": " "}]})), (2, "{x"), (3, None)]
    df = spark.createDataFrame(raw, "k int, raw string")
    assert [tuple(r) for r in X.connector_segments(df, ["k"], "raw").collect()] == [(1, 1.5, 2.0, "네", 0.9, "2")]
    assert [r.text for r in X.answers(spark.createDataFrame([(1, '[{"content":"a"},{"content":""},{"x":1}] rest')], "k int, raw string"), ["k"], "raw").collect()] == ["a  "]
    t = spark.createDataFrame([(1, "donkey", 0, "r", 1, "c")], "type_num int, source string, pos int, role string, index int, content string")
    X.write_transcripts(t, str(tmp_path / "out"))
    assert X.backed_up(spark, str(tmp_path / "out")) and not X.backed_up(spark, str(tmp_path / "out")) and not X.backed_up(spark, str(tmp_path / "none"))
    assert [r.text for r in sinks.text_report(t.select("type_num", "source"), "T").orderBy("line").collect()] == ["T", "type_num | source", "1 | donkey"]

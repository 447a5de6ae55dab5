import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from turnmill.sources import audio, dictionary, sinks, transcripts
from turnmill.streaming import segments


def test_tolerant_transcripts(spark):
    raw = ['[{"role":"a","index":1,"content":"x"},{"role":"b","index":2,"content":" "}] end ]x', "[{bad", "", None, "plain", '{"a":[1]}']
    df = spark.createDataFrame(list(enumerate(raw)), "k int, t string")
    assert [(r.k, r.pos, r.content) for r in transcripts.rows(df.where("k <> 0"), ["k"], "t").collect()] == []
    ok = spark.createDataFrame([(0, '[{"role":"a","index":1,"content":"x"}]\nend')], "k int, t string")
    assert transcripts.joined(ok, ["k"], "t").first().text == "x"
    assert {r.text for r in transcripts.corpus(df, ["k"], "t").collect()} >= {"plain"}


def test_transcript_directory(spark, tmp_path):
    for n, text in (("donkey_type2.txt", '[{"role":"의사","index":0,"content":"네"}] trailer'), ("dalpha_type2.txt", "broken")):
        (tmp_path / n).write_text(text)
    got = transcripts.read_directory(spark, str(tmp_path))
    assert [(r.type_num, r.source, r.content) for r in got.collect()] == [(2, "donkey", "네")]
    transcripts.write_transcripts(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_dictionary_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿wrong,correct,category,strategy,priority,enabled,notes\n가,나,,exact,x,TRUE,\n".encode())
    r = dictionary.read_csv(spark, str(tmp_path / "r.csv")).first()
    assert (r.wrong, r.correct, r.category, r.priority, r.enabled) == ("가", "나", "general", 50, True)
    dictionary.write_csv(spark.createDataFrame([("a", ["x", "y"])], "wrong string, context_hint array<string>"), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().context_hint == "x|y"


def test_dictionary_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"version":"1","entries":[{"id":"1","wrong":"a","correct":"b","strategy":"exact","context_hint":["h"],"priority":3,"enabled":true}]}')
    assert dictionary.read_document(spark, str(tmp_path / "d.json")).first().context_hint == ["h"]


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1600) / 10).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(audio.encode(x, 1600))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    df = audio.read_directory(spark, str(tmp_path))
    got = {r.path[-5:]: r for r in df.select("path", audio.durations(F.col("content")).alias("d"), audio.samples(F.col("content")).alias("s")).collect()}
    assert got["a.wav"].d == 1.0 and np.allclose(got["a.wav"].s.samples, x, atol=1e-3)
    assert got["b.wav"].d is None


def test_report_history(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    for run in ("r1", "r2"):
        sinks.write_report(df, str(tmp_path), run)
    assert {r.run_id for r in sinks.history(spark, str(tmp_path)).collect()} == {"r1", "r2"}
    assert spark.read.json(f"{tmp_path}/latest").first().run_id == "r2"


def test_stream_takes_redelivered_segments_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "f", 1, 0.0, 1.0, "a", None, None, at), (2, "f", 1, 0.0, 1.0, "a", None, None, at), (3, "f", 2, 1.0, 2.0, "b", None, None, at)]
    spark.createDataFrame(rows, segments.SEGMENT).write.parquet(f"{tmp_path}/in")
    q = segments.once(segments.read(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([("x",)], "wrong string").write.parquet(f"{tmp_path}/rules")
    segments.corrected(segments.read(spark, f"{tmp_path}/in"), f"{tmp_path}/rules", lambda d, r: d.withColumn("rules", F.lit(r.count())), f"{tmp_path}/fixed", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/fixed").count() == 3


def test_sessions_as_table(spark):
    rows = [("f", dt.datetime(2024, 1, 1, 0, 0)), ("f", dt.datetime(2024, 1, 1, 0, 10)), ("f", dt.datetime(2024, 1, 1, 5, 0))]
    got = segments.sessions(spark.createDataFrame(rows, "file_id string, received_at timestamp")).collect()
    assert sorted(r.segments for r in got) == [1, 2]


def test_wavs_are_written(spark, tmp_path):
    from turnmill.sources import audio

    df = spark.createDataFrame([("a", [0.0, 0.5, -1.0]), ("b", None)], "name string, samples array<double>")
    got = {r.name: r.bytes for r in audio.write_wavs(df, f"file://{tmp_path}/out", 16000).collect()}
    assert got == {"a": 44 + 6, "b": 44}
    assert audio.decode((tmp_path / "out" / "a.wav").read_bytes())[0] == 16000

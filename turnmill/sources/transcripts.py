"""Transcripts stored as JSON arrays of turns, with or without text after the array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, index: int, content: string, start: double, end: double>>"


def trimmed_array(raw: Column) -> Column:
    """The text up to the last closing bracket; null where there is no array."""
    end = F.length(raw) - F.instr(F.reverse(raw), "]") + 1
    return F.when(F.contains(raw, F.lit("]")) & F.ltrim(F.regexp_replace(raw, r"^[\s\x{FEFF}]+", "")).startswith("["), F.substring(raw, F.lit(1), end))


def turns(raw: Column) -> Column:
    """Array of turns; null for null, empty, broken and non-array texts."""
    return F.from_json(trimmed_array(raw), TURNS)


def rows(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """One row a turn: key, pos (from 0), role, index, content."""
    return df.select(*key, F.posexplode(turns(F.col(raw))).alias("pos", "t")).select(*key, "pos", "t.role", "t.index", "t.content")


def joined(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """The turns' contents in the order of the array, empty ones skipped, with one space between."""
    said = F.filter(F.transform(turns(F.col(raw)), lambda t: F.trim(t["content"])), lambda c: c != "")
    return df.select(*key, F.array_join(said, " ").alias("text")).where("text is not null")


def answers(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """As ``joined``, but nothing is trimmed or skipped: an empty or missing content still has its place."""
    said = F.transform(turns(F.col(raw)), lambda t: F.coalesce(t["content"], F.lit("")))
    return df.select(*key, F.array_join(said, " ").alias("text")).where("text is not null")


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")


def read_texts(spark: SparkSession, path: str, types: DataFrame) -> DataFrame:
    """(type_num, text, missing) of ``typeN_full_transcript.txt`` below the path for the wanted types; a missing file is marked."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="type*_full_transcript.txt").withColumn("file", F.input_file_name())
    found = files.select(F.regexp_extract("file", r"type(\d+)_full_transcript", 1).try_cast("int").alias("type_num"), stripped(F.col("value")).alias("text"))
    return types.select("type_num").distinct().join(found, "type_num", "left").withColumn("missing", F.col("text").isNull())


RESPONSE = "segments array<struct<start: bigint, end: bigint, text: string, confidence: double, speaker: struct<label: string>>>"


def connector_segments(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """Segments of a recogniser's JSON responses, milliseconds as seconds; blank texts and broken responses have none."""
    rows = df.select(*key, F.inline(F.from_json(raw, RESPONSE)["segments"]))
    x = rows.select(*key, (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), "text", "confidence", F.col("speaker.label").alias("speaker"))
    return x.where(stripped(F.coalesce("text", F.lit(""))) != "")


def corpus(df: DataFrame, key: list[str], raw: str) -> DataFrame:
    """Texts for counting word sequences: the contents of an array, else the raw text."""
    parsed = turns(F.col(raw))
    texts = F.when(parsed.isNotNull(), F.transform(parsed, lambda t: t["content"])).otherwise(F.array(F.col(raw)))
    return df.where(F.col(raw).isNotNull()).select(*key, F.explode(texts).alias("text")).where("trim(text) <> ''")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(type_num, source, pos, role, index, content) of every ``<source>_typeN.txt`` below the path; broken files have no rows."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("file", F.input_file_name())
    files = files.withColumn("type_num", F.regexp_extract("file", r"type(\d+)", 1).try_cast("int")).withColumn("source", F.regexp_extract("file", r"([A-Za-z]+)_type\d+\.txt$", 1))
    return rows(files.where("type_num is not null and source <> ''"), ["type_num", "source"], "value")


def write_transcripts(df: DataFrame, path: str, partition: str = "type_num") -> None:
    """Turns back to one JSON array a key, partitioned."""
    made = df.groupBy("type_num", "source").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "index", "content"))), lambda t: F.struct(t["role"].alias("role"), t["index"].alias("index"), t["content"].alias("content")))).alias("turns"))
    made.write.mode("overwrite").partitionBy(partition).json(path)


def backed_up(spark: SparkSession, path: str, suffix: str = ".bak_v1") -> bool:
    """Copies the folder beside itself unless that was done before; whether it was done now."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    to = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + suffix)
    if not fs.exists(fs_path) or fs.exists(to):
        return False
    return bool(spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, fs_path, fs, to, False, spark._jsc.hadoopConfiguration()))

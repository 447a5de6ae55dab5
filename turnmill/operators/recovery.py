"""Recognition repeated where it failed: in silences and where it was unsure. The recogniser is a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import folds
from turnmill.operators import sequences as S

Recogniser = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
HEARD = "file_id string, gap_start double, start double, end double, text string"


def retranscribed(gaps: DataFrame, hear: Recogniser, padding: float = 0.5) -> DataFrame:
    """(file_id, gap_start, start, end, text) heard in the gaps, in the file's time.

    ``hear`` gets batches of (file_id, gap_start, gap_end) and gives times from the start of the padded piece of sound.
    Texts of one character are noise.
    """
    heard = gaps.select("file_id", "gap_start", "gap_end").mapInArrow(hear, HEARD)
    shift = F.col("gap_start") - F.least(F.lit(padding), F.col("gap_start"))
    placed = lambda c: F.round((F.col(c) + shift).cast("decimal(18,6)"), 2).cast("double").alias(c)
    return heard.where(F.length(F.trim("text")) > 1).select("file_id", "gap_start", placed("start"), placed("end"), F.trim("text").alias("text"))


def tried_again(gaps: DataFrame, hear: Recogniser, times: int = 2) -> DataFrame:
    """``retranscribed``, and once more for gaps in which nothing was heard, up to ``times`` in all."""
    found = retranscribed(gaps, hear)
    for _ in range(times - 1):
        rest = gaps.join(found.select("file_id", "gap_start").distinct(), ["file_id", "gap_start"], "left_anti")
        found = found.unionByName(retranscribed(rest, hear))
    return found


def merged(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments with what was recovered (seq from -1 downward), those that share their time once."""
    w = Window.partitionBy("file_id").orderBy("start", "end", "text")
    new = found.select("file_id", (-F.row_number().over(w)).alias("seq"), "start", "end", "text")
    return folds.without_overlaps(segments.select("file_id", F.col("seq").cast("int").alias("seq"), "start", "end", "text").unionByName(new))


def counters(gaps: DataFrame, found: DataFrame) -> DataFrame:
    """Per file: gaps, gaps in which something was heard, and segments recovered."""
    n = found.groupBy("file_id", "gap_start").agg(F.count("*").alias("n"))
    return gaps.join(n, ["file_id", "gap_start"], "left").groupBy("file_id").agg(F.count("*").alias("gaps"), F.count("n").alias("recovered_gaps"), F.coalesce(F.sum("n"), F.lit(0)).alias("recovered_segments"))


def unsure(confidence: Column, least: float = 0.5) -> Column:
    """A known confidence under the least one; 0 counts as unknown."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)) < least, F.lit(False))


def retried(df: DataFrame, again: Column, least: float = 0.5, share: float = 0.5) -> DataFrame:
    """Texts of unsure segments replaced by a second recognition that is at least ``share`` as long; adds ``retried``."""
    taken = unsure(F.col("confidence"), least) & (F.trim(again) != "") & (F.length(F.trim(again)) >= F.length(F.coalesce("text", F.lit(""))) * share)
    return df.withColumn("retried", F.coalesce(taken, F.lit(False))).withColumn("text", F.when(F.col("retried"), F.trim(again)).otherwise(F.col("text")))


def revised(df: DataFrame, answer: Column, most: float = 0.45, limit: int = 15) -> DataFrame:
    """Texts of the first ``limit`` rows of each file with a confidence up to ``most`` replaced by a model's answer; adds ``revised``."""
    low = df.withColumn("__low", F.coalesce(F.col("confidence") <= most, F.lit(False)))
    ranked = S.batches(low.where("__low").select("file_id", "seq"), 1).where(F.col("place") <= limit).select("file_id", "seq", F.lit(True).alias("__due"))
    x = low.drop("__low").join(ranked, ["file_id", "seq"], "left")
    due = F.coalesce("__due", F.lit(False)) & F.coalesce(F.trim(answer) != "", F.lit(False)) & ~answer.eqNullSafe(F.col("text"))
    return x.withColumn("revised", due).withColumn("text", F.when(F.col("revised"), answer).otherwise(F.col("text"))).drop("__due")


def prompt_tails(df: DataFrame, length: float = 60.0, most: int = 400) -> DataFrame:
    """(file_id, chunk, tail): the last ``most`` characters said before each chunk of ``length`` seconds; chunks without text have no row.

    A chunk adds a character at least, so no more than ``most`` chunks before one matter.
    """
    rows = df.where("`start` is not null and trim(text) <> ''").withColumn("chunk", F.floor(F.col("start") / length))
    said = rows.groupBy("file_id", "chunk").agg(F.right(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", F.trim("text").alias("t")))), lambda x: x["t"]), " "), F.lit(most)).alias("said"))
    w = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(-most, -1)
    return said.select("file_id", "chunk", F.right(F.array_join(F.collect_list("said").over(w), " "), F.lit(most)).alias("tail"))


def mentions(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, term, at): the terms of two characters or more that a text holds, with their first place, from 1.

    Texts and terms meet on a term's first two characters, looked up among the neighbouring pairs of each text.
    """
    v = terms.where(F.length("term") >= 2).select("term").distinct().withColumn("piece", F.left("term", F.lit(2)))
    t = texts.where(F.length(text) >= 2).select(*key, F.col(text).alias("__t"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__t") - 1), lambda i: F.substring("__t", i, F.lit(2))))
    return t.withColumn("piece", F.explode(pieces)).join(v, "piece").withColumn("at", F.instr("__t", F.col("term"))).where("at > 0").select(*key, "term", "at")


def long_form(df: DataFrame, length: float = 60.0, overlap: float = 2.0) -> DataFrame:
    """A long recording recognised chunk by chunk, put together: (file_id, seq, start, end, text).

    Each segment comes once for every chunk that hears it; what a chunk repeats of the last kept segment is dropped, and
    a segment without words, which repeats nothing, is taken once.
    """
    heard = S.overlapping_windows(df, length, overlap).select("file_id", "seq", "start", "end", "text")
    return folds.without_chunk_repeats(heard).dropDuplicates(["file_id", "seq"])

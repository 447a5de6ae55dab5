"""Joins: intervals against intervals, similar words, index and position, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.text import jamo


def speaker_of_segments(segments: DataFrame, turns: DataFrame, least: float = 0.05, bin_s: float = 30.0) -> DataFrame:
    """Gives each segment the speaker of the interval that holds its middle, else of the one it overlaps most.

    ``segments`` (file_id, seq, start, end), ``turns`` (file_id, ord, start, end,
    speaker). The first interval in order wins among several that hold the
    middle, and among equal overlaps; an overlap under ``least`` seconds, or no
    interval at all, gives null. Both sides meet on time bins, so no file is
    paired with itself in full.
    """
    bins = lambda lo, hi: F.sequence(F.floor(lo / bin_s), F.floor(hi / bin_s))
    known = (F.col("start") <= F.col("end"))
    left = segments.where(known).select("file_id", "seq", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(bins(F.col("start"), F.col("end"))).alias("bin"))
    right = turns.where(known).select("file_id", "ord", "speaker", F.col("start").alias("ts"), F.col("end").alias("te"), F.explode(bins(F.col("start"), F.col("end"))).alias("bin"))
    pairs = left.join(right, ["file_id", "bin"]).where((F.col("ts") <= F.col("e")) & (F.col("te") >= F.col("s")))
    # a pair that shares several bins counts in the first of them
    pairs = pairs.where(F.col("bin") == F.greatest(F.floor(F.col("s") / bin_s), F.floor(F.col("ts") / bin_s)))
    mid = (F.col("s") + F.col("e")) / 2
    stab = (F.col("ts") <= mid) & (mid <= F.col("te"))
    overlap = F.least("e", "te") - F.greatest("s", "ts")
    best = pairs.where(stab | (overlap >= least)).groupBy("file_id", "seq").agg(
        F.min(F.struct((~stab).alias("apart"), F.when(stab, F.lit(0.0)).otherwise(-overlap).alias("by"), "ord", "speaker")).alias("x")
    )
    return segments.select("file_id", "seq").join(best, ["file_id", "seq"], "left").select("file_id", "seq", F.col("x")["speaker"].alias("speaker"))


#: Up to this many letters two similar words share a single letter at least, beyond it two neighbouring ones.
FEW_LETTERS = 5


def _pieces(letters: Column) -> Column:
    """Pairs of neighbouring letters, and of few letters the letters themselves."""
    n = F.length(letters)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(letters, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    single = F.when(n <= FEW_LETTERS, F.filter(F.split(letters, ""), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pairs, single))


def similar_words(words: DataFrame, vocabulary: DataFrame, least: float = 0.6, top: int = 3) -> DataFrame:
    """(word, term, similarity, place): the ``top`` most similar terms of every word of two characters or more.

    Similarity is one minus the edit distance over letters of syllables by the longer length. Only lengths that differ
    by at most half the word (2 at least) are compared. Distinct words are compared, not occurrences.

    Words and terms meet on pieces that they must share: of two strings at a distance of up to 0.4 of the longer length
    L, more than L / 2 letters stay in fewer runs than there are letters, once L is 6 or more, so two of them are
    neighbours in both; below that one letter is shared. ``least`` may not be under 0.6 therefore.
    """
    if least < 0.6:
        raise ValueError("words of a similarity under 0.6 need share no two letters")
    w = words.where(F.length("word") >= 2).select("word").distinct().withColumn("n", F.length("word")).withColumn("wj", jamo(F.col("word")))
    v = vocabulary.select("term").where("term is not null").distinct().withColumn("tn", F.length("term")).withColumn("tj", jamo(F.col("term")))
    longest = F.greatest(F.length("wj"), F.length("tj"))
    # lengths bound the distance from below, so hopeless pairs never reach the edit distance
    near = (F.abs(F.col("tn") - F.col("n")) <= F.greatest(F.floor(F.col("n") / 2), F.lit(2))) & (F.abs(F.length("wj") - F.length("tj")) <= (1 - least) * longest)
    met = w.withColumn("piece", F.explode(_pieces(F.col("wj")))).join(v.withColumn("piece", F.explode(_pieces(F.col("tj")))), "piece").where(near)
    pairs = met.groupBy("word", "term").agg(F.first("wj").alias("wj"), F.first("tj").alias("tj"))
    pairs = pairs.withColumn("similarity", 1 - F.levenshtein("wj", "tj") / longest).where(F.col("similarity") >= least)
    rank = Window.partitionBy("word").orderBy(F.desc("similarity"), "term")
    return pairs.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top).select("word", "term", F.round("similarity", 6).alias("similarity"), "place")


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str, columns: list[str]) -> DataFrame:
    """Left join with the first row (by ``order``) of each key on the right."""
    first = right.groupBy(*on).agg(F.min_by(F.struct(*columns), order).alias("__x"))
    out = left.join(first, on, "left")
    for c in columns:
        out = out.withColumn(f"right_{c}", F.col("__x")[c])
    return out.drop("__x")


def zipped(a: DataFrame, b: DataFrame, on: list[str], column: str, filler: str = "") -> DataFrame:
    """Full outer join on key and position; the missing side gets the filler."""
    left = a.select(*on, F.col(column).alias("left_value"))
    right = b.select(*on, F.col(column).alias("right_value"))
    both = left.join(right, on, "full")
    return both.select(*on, F.coalesce("left_value", F.lit(filler)).alias("left_value"), F.coalesce("right_value", F.lit(filler)).alias("right_value"), (F.col("left_value").isNull() | F.col("right_value").isNull()).alias("missing"))


def compared(before: DataFrame, after: DataFrame, on: list[str], metric: str, tolerance: float) -> DataFrame:
    """Two runs side by side with difference and status: worse, better, same, or no_data where a side lacks the metric."""
    a = before.select(*on, F.col(metric).alias("before"))
    b = after.select(*on, F.col(metric).alias("after"))
    diff = F.round(F.col("after") - F.col("before"), 4)
    status = F.when(diff.isNull(), "no_data").when(diff > tolerance, "worse").when(diff < -tolerance, "better").otherwise("same")
    return a.join(b, on, "full").select(*on, "before", "after", diff.alias("diff"), status.alias("status"))


def against_baseline(before: DataFrame, after: DataFrame, on: list[str], metric: str, tolerance: float) -> DataFrame:
    """As ``compared``, but only what both runs have."""
    return compared(before, after, on, metric, tolerance).where("before is not null and after is not null")


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many distinct keywords the text holds; 0 for null."""
    return F.coalesce(sum((F.when(F.contains(text, F.lit(k)), 1).otherwise(0) for k in keywords), F.lit(0)), F.lit(0))

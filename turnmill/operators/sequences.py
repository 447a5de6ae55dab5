"""Sequence operators over the ordered segments of a file.

Input rows have ``file_id``, an integer order ``seq`` and the columns named in
each function. Rows with a null ``seq`` come first. All are exact however long
a file is; see ``blocked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import blocked

KEY = ["file_id"]
ORDER = ["seq"]


#: Where ``once`` leaves the block of each row, by which its rows are already dealt out.
DEALT = "__block"


def once(df: DataFrame) -> DataFrame:
    """Each segment once: re-deliveries share (file_id, seq) and content.

    Rows are dealt out by (file, block), which serves to find copies and all ordered work that follows, so that is one
    shuffle for both; ``DEALT`` holds the block.
    """
    rows = df.where("file_id is not null and seq is not null").withColumn(DEALT, blocked.block_of(F.col("seq")))
    return rows.repartition("file_id", DEALT).dropDuplicates(["file_id", "seq", DEALT])


def in_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.col(DEALT) if DEALT in df.columns else blocked.block_of(F.col("seq")))


def time_gaps(df: DataFrame, durations: DataFrame, least: float = 1.0) -> DataFrame:
    """Silences by neighbours in time: head and tail longer than ``least``, inner ones of at least ``least`` seconds.

    Uses the neighbour's end, not the furthest end so far. Segments without both bounds are left out.
    """
    rows = df.where("`start` is not null and `end` is not null").withColumn("block", blocked.block_of(F.col("start"), 1800.0))
    rows = blocked.neighbours(rows, KEY, "block", ["start", "seq"], ["end"], before=True)
    inner = rows.where(F.col("prev_end").isNotNull() & (F.col("start") - F.col("prev_end") >= least)).select(
        "file_id", F.lit("inner").alias("place"), F.col("prev_end").alias("gap_start"), F.col("start").alias("gap_end")
    )
    ends = rows.groupBy("file_id").agg(F.min(F.struct("start", "seq"))["start"].alias("first"), F.max(F.struct("start", "seq", "end"))["end"].alias("last"))
    ends = ends.join(durations.select("file_id", "duration_s"), "file_id", "left")
    head = ends.where(F.col("first") > least).select("file_id", F.lit("head").alias("place"), F.lit(0.0).alias("gap_start"), F.col("first").alias("gap_end"))
    tail = ends.where(F.col("duration_s") - F.col("last") > least).select("file_id", F.lit("tail").alias("place"), F.col("last").alias("gap_start"), F.col("duration_s").alias("gap_end"))
    return inner.unionByName(head).unionByName(tail)


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Drops a row whose trimmed text equals that of the row before; null texts equal nothing."""
    rows = in_blocks(df).withColumn("__t", F.trim(text))
    rows = blocked.neighbours(rows, KEY, "block", ORDER, ["__t"])
    return rows.where(F.col("prev___t").isNull() | F.col("__t").isNull() | (F.col("prev___t") != F.col("__t"))).drop("__t", "prev___t", "block")


def merged_same_speaker(df: DataFrame, within: float = 0.2) -> DataFrame:
    """Runs of one speaker whose pauses are shorter than ``within`` seconds, as one row: first start, last end, joined text, least confidence.

    Where a bound is missing no pause is known, so the run ends there.
    """
    rows = blocked.neighbours(in_blocks(df), KEY, "block", ORDER, ["speaker", "end"])
    goes_on = F.col("speaker").eqNullSafe(F.col("prev_speaker")) & (F.col("start") - F.col("prev_end") < within)
    starts = ~F.coalesce(goes_on, F.lit(False))
    rows = blocked.running_count(rows, KEY, "block", ORDER, starts, "island")
    return rows.groupBy("file_id", "island").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("speaker", "seq").alias("speaker"),
        F.min_by("start", "seq").alias("start"),
        F.max_by("end", "seq").alias("end"),
        F.min("confidence").alias("confidence"),
        F.count("*").alias("segments"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def runs(df: DataFrame, column: str) -> DataFrame:
    """Maximal runs of one value in order: (file_id, run, value, first_seq, last_seq, length)."""
    rows = blocked.neighbours(in_blocks(df), KEY, "block", ORDER, [column, "seq"])
    starts = F.col("prev_seq").isNull() | ~F.col(column).eqNullSafe(F.col(f"prev_{column}"))
    rows = blocked.running_count(rows, KEY, "block", ORDER, starts, "run")
    return rows.groupBy("file_id", "run").agg(
        F.min_by(column, "seq").alias("value"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("length")
    )


def with_runs(df: DataFrame, column: str) -> DataFrame:
    """Adds ``run`` and ``run_length``: the number within the file, and the rows, of the maximal run of one value that a row is in."""
    rows = blocked.neighbours(in_blocks(df), KEY, "block", ORDER, [column, "seq"])
    starts = F.col("prev_seq").isNull() | ~F.col(column).eqNullSafe(F.col(f"prev_{column}"))
    rows = blocked.running_count(rows, KEY, "block", ORDER, starts, "run")
    lengths = rows.groupBy("file_id", "run").agg(F.count("*").alias("run_length"))
    return rows.drop(f"prev_{column}", "prev_seq", "block").join(lengths, ["file_id", "run"])


def spread(df: DataFrame, flag: Column, reach: int = 2) -> DataFrame:
    """Adds ``marked``: whether a flagged row lies at most ``reach`` places away in the file's order."""
    rows = blocked.shifted(in_blocks(df).withColumn("__f", F.coalesce(flag, F.lit(False))), KEY, "block", ORDER, ["__f"], reach, reach)
    near = F.col("__f")
    for i in range(1, reach + 1):
        near = near | F.coalesce(f"prev{i}.__f", F.lit(False)) | F.coalesce(f"next{i}.__f", F.lit(False))
    names = [f"{side}{i}" for side in ("prev", "next") for i in range(1, reach + 1)]
    return rows.withColumn("marked", near).drop("__f", "block", *names)


def filled(df: DataFrame, column: str, name: str) -> DataFrame:
    """Forward then backward fill in order."""
    return blocked.filled(in_blocks(df), KEY, "block", ORDER, column, name).drop("block")


def batches(df: DataFrame, size: int) -> DataFrame:
    """Adds ``place`` (from 1, in order) and ``batch`` of ``size`` rows."""
    rows = blocked.running_count(in_blocks(df), KEY, "block", ORDER, F.lit(True), "place")
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("block")


def context(df: DataFrame, before: int, after: int, text: str = "text", own: bool = False) -> DataFrame:
    """(file_id, seq, context): the texts of up to ``before`` rows before and ``after`` rows after (and of the row itself), joined; null texts are left out."""
    rows = blocked.shifted(in_blocks(df).select(*KEY, *ORDER, "block", F.col(text).alias("__t")), KEY, "block", ORDER, ["__t"], before, after)
    seen = [F.col(f"prev{i}.__t") for i in range(before, 0, -1)] + ([F.col("__t")] if own else []) + [F.col(f"next{i}.__t") for i in range(1, after + 1)]
    return rows.select(*KEY, *ORDER, F.concat_ws(" ", *seen).alias("context"))


def overlapping_windows(df: DataFrame, length: float = 60.0, overlap: float = 2.0) -> DataFrame:
    """Fixed windows with a left overlap: each segment appears in every window whose span it meets and whose boundary it passes."""
    known = df.where("`start` is not null and `end` > `start`")
    lo = F.floor(F.col("start") / length)
    hi = F.floor((F.col("end") + overlap) / length)
    spread_ = known.select("*", F.explode(F.sequence(lo, hi)).alias("window"))
    begins = F.greatest(F.col("window") * length - overlap, F.lit(0.0))
    boundary = F.col("window") * length
    return spread_.where((F.col("end") > begins) & (F.col("start") < (F.col("window") + 1) * length) & ((F.col("window") == 0) | (F.col("end") > boundary)))


def first_occurrences(df: DataFrame, key: list[str], item: str, order: list[str], most: int | None = None) -> DataFrame:
    """Items in the order of their first occurrence within the key, once each, the first ``most`` of them."""
    firsts = df.where(F.col(item).isNotNull()).groupBy(*key, item).agg(F.min(F.struct(*order)).alias("__at"))
    w = Window.partitionBy(*key).orderBy("__at", item)
    out = firsts.withColumn("place", F.row_number().over(w))
    return (out.where(F.col("place") <= most) if most else out).drop("__at")


def continuity(df: DataFrame, base: int = 1) -> DataFrame:
    """Per file: rows, lowest and highest number, and whether the numbers run without holes from ``base``."""
    return df.groupBy("file_id").agg(F.count("*").alias("rows"), F.min("seq").alias("lowest"), F.max("seq").alias("highest")).withColumn(
        "continuous", (F.col("lowest") == base) & (F.col("highest") - F.col("lowest") + 1 == F.col("rows"))
    )

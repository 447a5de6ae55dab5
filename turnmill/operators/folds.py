"""Stateful folds over ordered segments, cut where the state can't matter.

Both folds compare a segment with the last one kept. Where a segment begins
after everything before it has ended, it is kept whatever the state, so a chain
ends there and chains are folded apart from each other, each as a stream of
sorted rows with one row of state. Segments without both bounds belong to no
chain and are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import blocked

COLUMNS = ["file_id", "seq", "start", "end", "text"]
BOUNDED = "`start` is not null and `end` is not null"


class Row(NamedTuple):
    at: tuple[int, int]  # batch and place in it
    start: float
    end: float
    text: str | None


def chains(df: DataFrame, slack: float = 0.0) -> DataFrame:
    """Adds ``chain``: a new one begins where a segment starts more than ``slack`` after the furthest end so far (at it, if slack is 0)."""
    rows = df.where(BOUNDED).withColumn("block", blocked.block_of(F.col("start"), 1800.0))
    within = Window.partitionBy("file_id", "block").orderBy("start", "seq")
    line = Window.partitionBy("file_id").orderBy("block")
    edges = rows.groupBy("file_id", "block").agg(F.max("end").alias("m"))
    edges = edges.select("file_id", "block", F.max("m").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    rows = rows.withColumn("near", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))).join(edges, ["file_id", "block"])
    reach = F.greatest("near", "far")
    apart = reach.isNull() | ((F.col("start") >= reach) if slack == 0 else (F.col("start") > reach + slack))
    return blocked.running_count(rows, ["file_id"], "block", ["start", "seq"], apart, "chain").drop("block", "near", "far")


#: What a step does with a row: keep it too, keep it instead of the last one, or drop it.
APPEND, REPLACE, DROP = 0, 1, 2


def _fold(df: DataFrame, slack: float, step: Callable[[Row, Row], int]) -> DataFrame:
    """The rows that ``step(last kept, row)`` leaves; a batch holds all state but the last kept row of the batch before."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Row | None = None
        chain, waiting = None, None  # the last kept row may still be replaced, so it is given out when the next is kept
        for n, b in enumerate(batches):
            d = {c: b.column(c).to_pylist() for c in ("file_id", "chain", "start", "end", "text")}
            take: list[int] = []
            for i in range(b.num_rows):
                row, at = Row((n, i), d["start"][i], d["end"][i], d["text"][i]), (d["file_id"][i], d["chain"][i])
                act = APPEND if last is None or at != chain else step(last, row)
                if act == DROP:
                    continue
                if act == APPEND and last is not None:
                    if last.at[0] == n:
                        take.append(last.at[1])
                    else:
                        yield waiting
                last, chain, waiting = row, at, None
            if last is not None and last.at[0] == n:
                waiting = b.slice(last.at[1], 1).select(COLUMNS)
            yield b.take(pa.array(take, pa.int64())).select(COLUMNS)
        if last is not None:
            yield waiting

    rows = chains(df.select(*COLUMNS), slack).repartition("file_id", "chain").sortWithinPartitions("file_id", "chain", "start", "seq")
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in COLUMNS)
    return rows.mapInArrow(kept, types).unionByName(df.where(f"not ({BOUNDED})").select(*COLUMNS))


def without_overlaps(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Of a segment and the last kept one that share more than ``share`` of the new one's time, the longer text stays; segments without length are kept."""

    def step(last: Row, r: Row) -> int:
        if r.end > r.start and (min(last.end, r.end) - max(last.start, r.start)) / (r.end - r.start) > share:
            return REPLACE if len(r.text or "") > len(last.text or "") else DROP
        return APPEND

    return _fold(df, 0.0, step)


def without_chunk_repeats(df: DataFrame, slack: float = 0.35, least: int = 6, tail: int = 12) -> DataFrame:
    """Drops a segment that begins at most ``slack`` after the last kept one ends and repeats it: equal, contained, or its head is the other's tail."""

    def step(last: Row, r: Row) -> int:
        t, p = (r.text or "").strip(), (last.text or "").strip()
        if t and p and r.start <= last.end + slack:
            shorter, longer = sorted((t, p), key=len)
            if t == p or (len(shorter) >= least and shorter in longer) or any(p[-k:] == t[:k] for k in range(least, tail + 1) if min(len(p), len(t)) >= k):
                return DROP
        return APPEND

    return _fold(df, slack, step)

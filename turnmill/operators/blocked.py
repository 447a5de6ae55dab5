"""Ordered operations within a key that spread a hot key over many tasks.

Rows are windowed within (key, block); one summary row a block carries the edge
values from block to block. So lag, lead, fill, running counts and islands are
exact over the whole key while no task sees more than one block of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrivals in a block of ordered rows.
ROWS = 4096


def block_of(order: Column, size: float = ROWS) -> Column:
    """The block of a numeric order column; null order goes to a block of its own, first."""
    return F.coalesce(F.floor(order / F.lit(size)).cast("bigint"), F.lit(-(1 << 40)))


def _windows(key: list[str], block: str, order: list[str]):
    within = Window.partitionBy(*key, block).orderBy(*order)
    line = Window.partitionBy(*key).orderBy(block)
    return within, line


def neighbours(df: DataFrame, key: list[str], block: str, order: list[str], columns: list[str], before: bool = True, after: bool = False) -> DataFrame:
    """Adds ``prev_c`` and ``next_c``: the columns of the row before and after in the key's order; null at its ends."""
    within, line = _windows(key, block, order)
    row = F.struct(*columns)
    out = df
    if before:
        out = out.withColumn("__p", F.lag(row).over(within))
    if after:
        out = out.withColumn("__n", F.lead(row).over(within))
    at = F.struct(*order)
    edges = df.groupBy(*key, block).agg(F.min_by(row, at).alias("__first"), F.max_by(row, at).alias("__last"))
    edges = edges.select(*key, block, F.lag("__last").over(line).alias("__pe"), F.lead("__first").over(line).alias("__ne"))
    out = out.join(edges, [*key, block])
    for c in columns:
        if before:
            out = out.withColumn(f"prev_{c}", F.coalesce(F.col("__p"), F.col("__pe"))[c])
        if after:
            out = out.withColumn(f"next_{c}", F.coalesce(F.col("__n"), F.col("__ne"))[c])
    return out.drop("__p", "__n", "__pe", "__ne")


def shifted(df: DataFrame, key: list[str], block: str, order: list[str], columns: list[str], before: int, after: int = 0) -> DataFrame:
    """Adds ``prev1`` to ``prevN`` and ``next1`` to ``nextN``: structs of the columns of the rows that many places away; null beyond the ends.

    Rows inside a block see their neighbours there. The few rows at its edges, and only they, meet the edges of other
    blocks in a window over the key, where their neighbours are edge rows too. No row is joined or copied.
    """
    within, line = Window.partitionBy(*key, block).orderBy(*order), Window.partitionBy(*key).orderBy(block, *order)
    row, reach = F.struct(*columns), max(before, after, 1)
    names = [(f"prev{i}", i, F.lag, "__place") for i in range(1, before + 1)] + [(f"next{i}", i, F.lead, "__left") for i in range(1, after + 1)]
    out = df.withColumn("__place", F.row_number().over(within))
    out = out.withColumn("__left", F.count("*").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("__place") + 1)
    for name, i, shift, _ in names:
        out = out.withColumn(name, shift(row, i).over(within))
    edge = (F.col("__place") <= reach) | (F.col("__left") <= reach)
    edges = out.where(edge)
    for name, i, shift, place in names:
        edges = edges.withColumn(name, F.when(F.col(place) > i, F.col(name)).otherwise(shift(row, i).over(line)))
    return out.where(~edge).unionByName(edges).drop("__place", "__left")


def running_count(df: DataFrame, key: list[str], block: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """Adds how many rows up to and with this one have the flag: an island number if the flag marks island starts."""
    within, line = _windows(key, block, order)
    hit = F.coalesce(flag.cast("bigint"), F.lit(0).cast("bigint"))
    out = df.withColumn("__hit", hit)
    totals = out.groupBy(*key, block).agg(F.sum("__hit").alias("__t"))
    totals = totals.select(*key, block, (F.sum("__t").over(line) - F.col("__t")).alias("__base"))
    out = out.withColumn("__run", F.sum("__hit").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(totals, [*key, block])
    return out.withColumn(name, F.col("__run") + F.col("__base")).drop("__hit", "__run", "__base")


def filled(df: DataFrame, key: list[str], block: str, order: list[str], column: str, name: str, backward: bool = True) -> DataFrame:
    """Adds the last known value of the column, forward, then (unless told not to) the first known one, backward."""
    within, line = _windows(key, block, order)
    last = F.last(column, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(column, ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing))
    at = F.struct(*order)
    known = F.col(column).isNotNull()
    edges = df.groupBy(*key, block).agg(
        F.max_by(F.when(known, F.col(column)), F.when(known, at)).alias("__l"), F.min_by(F.when(known, F.col(column)), F.when(known, at)).alias("__f")
    )
    edges = edges.select(
        *key,
        block,
        F.last("__l", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__le"),
        F.first("__f", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__fe"),
    )
    out = df.withColumn("__fw", last).withColumn("__bw", first).join(edges, [*key, block])
    return out.withColumn(name, F.coalesce("__fw", "__le", *(["__bw", "__fe"] if backward else []))).drop("__fw", "__bw", "__le", "__fe")

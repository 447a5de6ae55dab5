"""Coverage of integer time intervals: merged periods and the gaps between them.

Intervals are decomposed into canonical dyadic blocks (``[k*2^l, (k+1)*2^l)``).
Equal blocks collapse, complete sibling pairs are promoted to their parent,
blocks below a present ancestor are dropped, and what is left is coalesced into
maximal periods. Work is keyed by (entity, cell), a cell being ``2**CELL_BITS``
milliseconds, so that one entity holding a third of all rows is spread over
many tasks; only one summary row per cell meets the others of its entity. An
interval touches the cells of its two ends only; the whole cells between them are
the reach of the first one and, as an ancestor does, cover what lies under them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A cell is 2**20 ms, about 17.5 minutes.
CELL_BITS = 20
#: Bounds are held within this many units from zero, so that sums of them fit a bigint.
FURTHEST = 1 << 62
#: Rows gathered before the vectorised merge runs.
CHUNK_ROWS = 1 << 17


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray, bits: int) -> list[np.ndarray]:
    """The canonical blocks of every ``[lo, hi)``, as one array of block numbers a level.

    Intervals must not cross a multiple of ``2**bits``.
    """
    levels: list[np.ndarray] = []
    for level in range(bits + 1):
        alive = lo < hi
        lo, hi = lo[alive], hi[alive]
        if level == bits:
            levels.append(lo)
            break
        left, right = (lo & 1) == 1, (hi & 1) == 1
        levels.append(np.concatenate([lo[left], hi[right] - 1]))
        lo, hi = (lo + left) >> 1, (hi - right) >> 1
    return levels


def promote_siblings(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Collapse equal blocks and replace complete sibling pairs by their parent, upward."""
    out: list[np.ndarray] = []
    carried = np.empty(0, np.int64)
    for level, blocks in enumerate(levels):
        b = np.unique(np.concatenate([blocks, carried]))
        if level == len(levels) - 1 or len(b) < 2:
            carried = np.empty(0, np.int64)
            out.append(b)
            continue
        pair = np.zeros(len(b), bool)
        pair[:-1] = ((b[:-1] & 1) == 0) & (b[1:] == b[:-1] + 1)
        carried = b[pair] >> 1
        gone = pair.copy()
        gone[1:] |= pair[:-1]
        out.append(b[~gone])
    return out


def uncovered_blocks(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in order, of the blocks that lie under no other present block."""
    start = np.empty(0, np.int64)
    end = np.empty(0, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        s = levels[level] << level
        if not len(s):
            continue
        if len(start):
            at = np.searchsorted(start, s, "right") - 1
            s = s[(at < 0) | (end[np.maximum(at, 0)] <= s)]
        start, end = np.concatenate([start, s]), np.concatenate([end, s + (1 << level)])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, end


def merge_on_line(lo: np.ndarray, hi: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Maximal periods covered by ``[lo, hi)``; periods never join across a multiple of ``2**bits``."""
    s, e = uncovered_blocks(promote_siblings(dyadic_blocks(lo, hi, bits)))
    if not len(s):
        return s, e
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != e[:-1]) | ((s[1:] & ((1 << bits) - 1)) == 0)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(s)) - 1
    return s[first], e[last]


def _run_starts(entity: pa.Array, cell: np.ndarray) -> np.ndarray:
    """Flags of the rows that begin a new (entity, cell) run."""
    flags = np.ones(len(cell), bool)
    if len(cell) > 1:
        a, b = entity.slice(1), entity.slice(0, len(cell) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        flags[1:] = differ | nulls | (cell[1:] != cell[:-1])
    return flags


def _cell_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (entity, cell) from rows sorted by both, merging in bounded chunks."""
    held: list[pa.Table] = []
    rows = 0

    def merged(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        entity = t.column("entity").combine_chunks()
        if isinstance(entity, pa.ChunkedArray):
            entity = entity.chunk(0) if entity.num_chunks else pa.array([], pa.string())
        cell = t.column("cell").to_numpy()
        lo, hi, reach = (t.column(c).to_numpy() for c in ("lo", "hi", "reach"))
        flags = _run_starts(entity, cell)
        run = np.cumsum(flags) - 1
        heads = np.flatnonzero(flags)
        far = np.maximum.reduceat(reach, heads)
        base = run.astype(np.int64) << CELL_BITS
        s, e = merge_on_line(base + lo, base + hi)
        of = s >> CELL_BITS
        s, e = s - (of << CELL_BITS), e - (of << CELL_BITS)
        kept = None
        n = len(heads)
        if not last:  # the last run may go on in the next chunk: keep it, already merged
            n -= 1
            mine = of == n
            m = int(mine.sum())
            kept = pa.Table.from_arrays(
                [entity.take(pa.array(np.full(m, heads[n]))), pa.array(np.full(m, cell[heads[n]])), pa.array(s[mine]), pa.array(e[mine]), pa.array(np.full(m, far[n]))],
                schema=t.schema,
            )
            s, e, of = s[~mine], e[~mine], of[~mine]
        if n == 0:
            return None, kept
        counts = np.bincount(of, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        at = cell[heads[:n]] << CELL_BITS
        s, e = s + np.repeat(at, counts), e + np.repeat(at, counts)
        period = pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["period_start", "period_end"])
        return (
            pa.RecordBatch.from_arrays(
                [
                    entity.take(pa.array(heads[:n])),
                    pa.array(cell[heads[:n]]),
                    pa.ListArray.from_arrays(pa.array(offsets), period),
                    pa.array(far[:n]),
                ],
                ["entity", "cell", "periods", "reach"],
            ),
            kept,
        )

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            out, kept = merged(pa.concat_tables(held), last=False)
            held, rows = ([kept] if kept is not None and kept.num_rows else []), 0
            if out is not None:
                yield out
    if held:
        out, _ = merged(pa.concat_tables(held), last=True)
        if out is not None:
            yield out


def cell_periods(df: DataFrame, entity: str, start: str, end: str, per_second: int = 1000) -> DataFrame:
    """(entity, cell, periods, reach): the merged periods of every entity within each cell, and the whole cells covered after it.

    Bounds are seconds, rounded half up to whole ``1/per_second`` and held within ``FURTHEST``; a row that
    lacks a bound (null, NaN or infinite) or doesn't end after it starts covers nothing. A null entity is an
    entity of its own. Cells that an earlier one reaches over are in the result; ``_uncovered`` settles them.
    """
    s, e = df[start].cast("double"), df[end].cast("double")
    endless = F.lit(float("inf"))
    ms = lambda c: F.floor(F.greatest(F.least(c * per_second + F.lit(0.5), F.lit(float(FURTHEST))), F.lit(float(-FURTHEST)))).cast("bigint")
    known = (F.abs(s) < endless) & (F.abs(e) < endless)  # NaN is above infinity
    spans = df.where(known & (s < e)).select(df[entity].cast("string").alias("entity"), ms(s).alias("s"), ms(e).alias("e"))
    spans = spans.where("s < e").withColumn("c1", F.shiftright("s", CELL_BITS)).withColumn("c2", F.shiftright(F.col("e") - 1, CELL_BITS))
    size, zero = 1 << CELL_BITS, F.lit(0).cast("bigint")

    def piece(cell, lo, hi, reach):
        return F.struct(cell.alias("cell"), lo.alias("lo"), hi.alias("hi"), reach.alias("reach"))

    head = piece(F.col("c1"), F.col("s") - F.col("c1") * size, F.least(F.col("e") - F.col("c1") * size, F.lit(size).cast("bigint")), F.greatest(F.col("c2") - F.col("c1") - 1, zero))
    tail = piece(F.col("c2"), zero, F.col("e") - F.col("c2") * size, zero)
    cells = spans.select("entity", F.inline(F.when(F.col("c2") > F.col("c1"), F.array(head, tail)).otherwise(F.array(head))))
    return (
        cells.repartition("entity", "cell")
        .sortWithinPartitions("entity", "cell")
        .mapInArrow(
            _cell_summaries,
            "entity string, cell bigint, periods array<struct<period_start: bigint, period_end: bigint>>, reach bigint",
        )
    )


def _uncovered(per: DataFrame) -> DataFrame:
    """Cells that no earlier one reaches over; one that is covered but reaches further holds just what it adds.

    ``ends`` is where a cell's reach ends, null without any.
    """
    line = Window.partitionBy("entity").orderBy("cell")
    size = 1 << CELL_BITS
    ends = F.when(F.col("reach") > 0, (F.col("cell") + 1 + F.col("reach")) * size)
    per = per.withColumn("ends", ends).withColumn("covered", F.max("ends").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    under = F.coalesce(F.col("covered") > F.col("cell") * size, F.lit(False))
    added = F.array(F.struct(F.col("covered").alias("period_start"), F.col("ends").alias("period_end")))
    return per.where(~under | (F.col("ends") > F.col("covered"))).withColumn("periods", F.when(under, added).otherwise(F.col("periods")))


def gaps(df: DataFrame, entity: str, start: str, end: str, shorter_than: int | None = 3_600_000, names: tuple[str, str] = ("gap_start_ms", "gap_end_ms")) -> DataFrame:
    """The gaps between neighbouring periods of each entity: (entity, start, end) in ms.

    Touching periods are one, so every gap is longer than 0; gaps of
    ``shorter_than`` or more are breaks and left out (None keeps them).
    An entity with fewer than two periods has no gap; an empty table gives none.
    """
    per = _uncovered(cell_periods(df, entity, start, end))
    line = Window.partitionBy("entity").orderBy("cell")
    inner = F.transform(
        F.sequence(F.lit(1), F.size("periods") - 1),
        lambda i: F.struct(F.col("periods")[i - 1]["period_end"].alias("s"), F.col("periods")[i]["period_start"].alias("e")),
    )
    inner = F.when(F.size("periods") > 1, inner).otherwise(F.array().cast("array<struct<s: bigint, e: bigint>>"))
    per = per.select(
        "entity",
        "cell",
        inner.alias("inner"),
        F.element_at("periods", 1)["period_start"].alias("first"),
        F.coalesce("ends", F.element_at("periods", -1)["period_end"]).alias("last"),
    )
    per = per.withColumn("next", F.lead("first").over(line))
    across = F.array(F.struct(F.col("last").alias("s"), F.coalesce("next", "last").alias("e")))
    out = per.select("entity", F.inline(F.concat("inner", across))).where("e > s")
    if shorter_than is not None:
        out = out.where(F.col("e") - F.col("s") < shorter_than)
    return out.select(F.col("entity").alias(entity), F.col("s").alias(names[0]), F.col("e").alias(names[1]))


def periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The continuous periods of each entity: (entity, period_start_ms, period_end_ms).

    A period that fills whole cells is stitched from its pieces: a piece starts a
    new period unless it touches the end of the cell before. Pieces that reach
    no cell edge are final within their cell and skip the stitching.
    """
    per = _uncovered(cell_periods(df, entity, start, end))
    size = 1 << CELL_BITS
    # the last period of a cell goes on to the end of its reach
    n = F.size("periods")
    reached = F.transform("periods", lambda p, i: F.struct(p["period_start"].alias("period_start"), F.when(i == n - 1, F.coalesce("ends", p["period_end"])).otherwise(p["period_end"]).alias("period_end")))
    flat = per.select("entity", F.inline(reached))
    edge = (F.pmod("period_start", F.lit(size)) == 0) | (F.pmod("period_end", F.lit(size)) == 0)
    flat = flat.withColumn("edge", edge)
    line = Window.partitionBy("entity", "edge").orderBy("period_start")
    # pieces inside a cell never touch another piece: only the few edge pieces share an ordered window
    flat = flat.withColumn("fresh", F.when(F.col("edge"), F.coalesce(F.col("period_start") != F.lag("period_end").over(line), F.lit(True))).otherwise(True))
    flat = flat.withColumn("island", F.when(F.col("edge"), F.sum(F.col("fresh").cast("int")).over(line)).otherwise(F.col("period_start")))
    return (
        flat.groupBy("entity", "edge", "island")
        .agg(F.min("period_start").alias("period_start_ms"), F.max("period_end").alias("period_end_ms"))
        .select(F.col("entity").alias(entity), "period_start_ms", "period_end_ms")
    )

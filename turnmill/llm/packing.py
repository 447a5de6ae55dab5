"""Problem 7: texts into containers of fixed capacity.

The plan is made on the histogram of sizes, which has at most ``capacity``
entries however many texts there are, so only that bounded table reaches the
driver. An index holds, for every sum up to the capacity, a combination of one,
two or three sizes with that sum. A container begins with the largest size left;
while its gap is no sum in the index the largest size that fits is added; then
the indexed combination closes it exactly. Availability counts are consumed as
containers are closed; an indexed combination that they no longer allow is
replaced by another one with the same sum or, once there is none, struck out for
good, as counts only fall. The pattern is repeated as often as the counts allow,
which uses up at least one size, so there are at most about twice as many
patterns as sizes. What can't be closed exactly keeps its best fit.

Texts are matched to the plan by their rank within their size, computed in two
levels (salted blocks, then block offsets), so that one size holding a third of
all texts is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that share a block of ranks, about; there are at least ``LEAST_BLOCKS`` a size.
BLOCK_ROWS, LEAST_BLOCKS = 1 << 20, 256


def _allowed(counts: np.ndarray, sizes: list[int]) -> bool:
    return all(counts[s] >= sizes.count(s) for s in sizes)


def _pair(counts: np.ndarray, total: int, used: int = 0) -> list[int] | None:
    """Two available sizes with that sum, the largest possible first; ``used`` is a size of which one is taken already."""
    sizes = np.flatnonzero(counts[: total + 1])
    a = sizes[np.searchsorted(sizes, (total + 1) // 2) :]
    a = a[a < total]
    there = counts[total - a] > 0
    if used:
        there &= (counts[a] > (a == used)) & (counts[total - a] > (total - a == used))
    if len(a) and int(a[0]) * 2 == total:
        there[0] = counts[a[0]] >= 2 + (a[0] == used)
    hit = np.flatnonzero(there)
    return [int(a[hit[-1]]), int(total - a[hit[-1]])] if len(hit) else None


def _triple(counts: np.ndarray, total: int) -> list[int] | None:
    """Three available sizes with that sum, the largest possible first."""
    sizes = np.flatnonzero(counts[: total + 1])
    # bit by bit, whether some a and the rest less a are there; counts are looked at only where they are
    there = counts > 0
    bits, mirrored = (int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little") for x in (there, there[::-1]))
    for third in map(int, sizes[np.searchsorted(sizes, (total + 2) // 3) :][::-1]):
        if third < total and bits & (mirrored >> (len(counts) - 1 - total + third)) and (two := _pair(counts, total - third, third)) is not None:
            return [third, *two]
    return None


class Sums:
    """For every sum up to the capacity: whether it is a size, and a member of a pair and of a triple with that sum (0: none)."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # falls as the plan consumes them
        n = len(counts)
        sizes = np.flatnonzero(counts)
        self.pair, self.triple = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for a in map(int, sizes):
            other = sizes[: np.searchsorted(sizes, min(a, n - 1 - a), "right")]
            self.pair[a + other[(other < a) | (counts[a] > 1)]] = a
        summed = self.pair > 0
        for a in map(int, sizes):
            self.triple[a:][summed[: n - a]] = a

    def closing(self, rest: np.ndarray, gap: int) -> list[int] | None:
        """Sizes that fill the gap exactly under the counts of what is left, the fewest possible."""
        if rest[gap] > 0:
            return [gap]
        if (a := int(self.pair[gap])) > 0:
            if _allowed(rest, [a, gap - a]):
                return [a, gap - a]
            if (two := _pair(rest, gap)) is not None:
                self.pair[gap] = two[0]
                return two
            self.pair[gap] = (_pair(self.counts, gap) or [0])[0]
        if (a := int(self.triple[gap])) > 0:
            b = int(self.pair[gap - a]) if gap > a else 0
            if b and _allowed(rest, [a, b, gap - a - b]):
                return [a, b, gap - a - b]
            if (three := _triple(rest, gap)) is not None:
                self.triple[gap] = three[0]
                return three
            self.triple[gap] = (_triple(self.counts, gap) or [0])[0]
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(sizes with their number in a container, number of such containers) for sizes of 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    out: list[tuple[dict[int, int], int]] = []
    index = Sums(counts)
    while True:
        left = np.flatnonzero(counts)
        if not len(left):
            return out
        gap, used = capacity, {}
        rest, sizes = counts.copy(), left
        top = int(left[-1])
        while gap and top:
            if used and (closing := index.closing(rest, gap)) is not None:
                for s in closing:
                    used[s] = used.get(s, 0) + 1
                break
            at = int(np.searchsorted(sizes, gap, "right")) - 1
            if at < 0:
                break
            top = int(sizes[at])
            # one item at a time near the end, so that an exact complement isn't jumped over
            n = min(int(rest[top]), gap // top)
            n = max(1, n - 4) if gap // top > 4 else 1
            used[top] = used.get(top, 0) + n
            rest[top] -= n
            gap -= n * top
            if not rest[top]:
                sizes = np.delete(sizes, at)
        times = min(int(counts[s]) // n for s, n in used.items())
        for s, n in used.items():
            counts[s] -= n * times
        out.append((used, times))


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (first rank of each stretch, its first container, items a container)."""
    ranks: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for used, times in patterns:
        for s, n in used.items():
            at = ranks.get(s, 0)
            found.setdefault(s, []).append((at, container, n))
            ranks[s] = at + n * times
        container += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*v)) for s, v in found.items()}


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """(capacity_id, container, id, piece, tokens) from (id, tokens), for every (capacity_id, capacity).

    A text above the capacity is cut into full pieces and one rest; no other is
    split. Texts without tokens need no room and lie in container 0. Null sizes
    count as 0. Without any capacity there is no container. ``sizes`` is read several times: give a written table.
    """
    of_id = sizes.schema[id_col].dataType.simpleString()
    if not capacities:
        return sizes.sparkSession.createDataFrame([], f"capacity_id int, container bigint, {id_col} {of_id}, piece int, tokens int")
    caps = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in capacities])
    each = sizes.select(F.col(id_col).alias("id"), F.coalesce("tokens", F.lit(0)).cast("int").alias("total"), F.explode(caps).alias("c")).select("id", "total", "c.*")
    salts = max(LEAST_BLOCKS, sizes.count() // BLOCK_ROWS)
    full = F.floor(F.col("total") / F.col("capacity")).cast("int")
    count = F.greatest(F.ceil(F.col("total") / F.col("capacity")), F.lit(1)).cast("int")
    pieces = each.select("id", "capacity_id", "capacity", "total", full.alias("full"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.select(
        "id",
        "capacity_id",
        "piece",
        F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("total") % F.col("capacity")).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int").alias("salt"),
    )
    blocks = pieces.groupBy("capacity_id", "tokens", "salt").agg(F.count("*").alias("n"))
    # at most capacity + 1 sizes a capacity
    totals = blocks.groupBy("capacity_id", "tokens").agg(F.sum("n").alias("n")).where("tokens > 0").collect()
    slots = {}
    for cid, cap in capacities:
        slots[cid] = _slots(plan({r.tokens: r.n for r in totals if r.capacity_id == cid}, cap))
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    by_size = Window.partitionBy("capacity_id", "tokens").orderBy("salt")
    offsets = blocks.withColumn("offset", F.sum("n").over(by_size) - F.col("n")).drop("n")
    inside = Window.partitionBy("capacity_id", "tokens", "salt").orderBy("id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["capacity_id", "tokens", "salt"])
    ranked = ranked.select("capacity_id", "id", "piece", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            container = np.zeros(len(f), np.int64)
            for (cid, size), rows in f.groupby(["capacity_id", "tokens"]).indices.items():
                if size:
                    first, base, n = shared.value[cid][size]
                    rank = f["rank"].to_numpy()[rows]
                    at = np.searchsorted(first, rank, "right") - 1
                    container[rows] = base[at] + (rank - first[at]) // n[at]
            f["container"] = container
            yield f[["capacity_id", "container", "id", "piece", "tokens"]]

    placed = ranked.mapInPandas(place, f"capacity_id int, container bigint, id {of_id}, piece int, tokens int")
    return placed.withColumnRenamed("id", id_col)

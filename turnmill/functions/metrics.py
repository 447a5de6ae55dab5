"""Error rates by aligned edit distance, and expressions built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from turnmill.functions.text import n1, squeeze

OPS = StructType(
    [
        StructField("distance", IntegerType()),
        StructField("substitutions", IntegerType()),
        StructField("deletions", IntegerType()),
        StructField("insertions", IntegerType()),
        StructField("ref_length", IntegerType()),
        StructField("hyp_length", IntegerType()),
        StructField("ops", ArrayType(StructType([StructField("op", StringType()), StructField("ref", StringType()), StructField("hyp", StringType())]))),
    ]
)
#: Cells of the table that one alignment may hold at once; longer pairs are aligned in halves.
MOST_CELLS = 4_000_000


def _costs(a: list, b: list) -> np.ndarray:
    """Last row of the edit distance table, one numpy row at a time."""
    codes: dict = {}
    x = np.array([codes.setdefault(v, len(codes)) for v in a], np.int64)
    y = np.array([codes.setdefault(v, len(codes)) for v in b], np.int64)
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for v in x:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != v))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def _table(first: np.ndarray, i0: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of the edit distance table below ``first``, which is row ``i0``."""
    steps = np.arange(len(y) + 1, dtype=np.int32)
    table = np.empty((len(x) + 1, len(y) + 1), np.int32)
    table[0] = first
    for i, v in enumerate(x, 1):
        new = np.empty(len(y) + 1, np.int32)
        new[0] = i0 + i
        new[1:] = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (y != v))
        table[i] = np.minimum.accumulate(new - steps) + steps
    return table


def align(a: list, b: list, insertion_first: bool = False) -> list[tuple[str, str, str]]:
    """(op, ref, hyp) from front to back: C equal, S changed, D left out, I put in.

    Seen from the end, equal items are always aligned; of equally short ways a change is preferred, then a deletion
    and then an insertion, or these two the other way round. At most ``MOST_CELLS`` cells are held at once: of a
    larger table only every so many rows are kept, and the rows between are computed again on the way back.
    """
    codes: dict = {}
    x = np.array([codes.setdefault(v, len(codes)) for v in a], np.int64)
    y = np.array([codes.setdefault(v, len(codes)) for v in b], np.int64)
    step = max(1, min(len(x) or 1, MOST_CELLS // (len(y) + 1)))
    kept = [np.arange(len(y) + 1, dtype=np.int32)]
    for at in range(0, len(x) - step, step):
        kept.append(_table(kept[-1], at, x[at : at + step], y)[-1].copy())
    out, i, j = [], len(a), len(b)
    for k in range(len(kept) - 1, -1, -1):
        lo = k * step
        table = _table(kept[k], lo, x[lo : lo + step], y)
        while i > lo or (k == 0 and j):
            here = table[i - lo, j]
            up = i > lo and here == table[i - lo - 1, j] + 1
            left = j > 0 and here == table[i - lo, j - 1] + 1
            if i > lo and j and x[i - 1] == y[j - 1]:
                out.append(("C", a[i - 1], b[j - 1]))
                i, j = i - 1, j - 1
            elif i > lo and j and here == table[i - lo - 1, j - 1] + 1:
                out.append(("S", a[i - 1], b[j - 1]))
                i, j = i - 1, j - 1
            elif left and (insertion_first or not up):
                out.append(("I", "", b[j - 1]))
                j -= 1
            else:
                out.append(("D", a[i - 1], ""))
                i -= 1
    return out[::-1]


def _aligner(insertion_first: bool):
    @F.pandas_udf(OPS)
    def aligned_pairs(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(ref, hyp):
            if r is None or h is None:
                rows.append((None,) * 7)
                continue
            ops = align(list(r), list(h), insertion_first)
            n = {k: sum(o == k for o, _, _ in ops) for k in "SDI"}
            rows.append((sum(n.values()), n["S"], n["D"], n["I"], len(r), len(h), [{"op": o, "ref": x, "hyp": y} for o, x, y in ops if o != "C"]))
        return pd.DataFrame(rows, columns=OPS.names)

    return aligned_pairs


_aligned, _aligned_insertions = _aligner(False), _aligner(True)


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(n1(c)), " "), lambda w: w != "")


def characters(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(n1(c), " ", ""), ""), lambda w: w != "")


def aligned(ref: Column, hyp: Column, insertion_first: bool = False) -> Column:
    """Edit operations between two arrays; null if either is null."""
    return (_aligned_insertions if insertion_first else _aligned)(ref, hyp)


def word_errors(ref: Column, hyp: Column) -> Column:
    return aligned(words(ref), words(hyp))


def character_errors(ref: Column, hyp: Column) -> Column:
    return aligned(characters(ref), characters(hyp))


def rate(distance: Column, length: Column) -> Column:
    """Errors by reference length; an empty reference counts as one."""
    return distance / F.greatest(length, F.lit(1))


def character_error_rate(ref: Column, hyp: Column, capped: bool = False, empty: str = "either") -> Column:
    """Distance of two normal forms by the length of the reference; the built-in distance, as only the rate is needed.

    An empty reference gives 1 if the hypothesis isn't empty and 0 else (``either``), always 0 (``zero``), or counts as one
    character (``one``).
    """
    n = F.length(ref)
    if empty == "one":
        out = F.levenshtein(ref, hyp) / F.greatest(n, F.lit(1))
    else:
        none = F.lit(0.0) if empty == "zero" else F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)
        out = F.when((n == 0) & hyp.isNotNull(), none).otherwise(F.levenshtein(ref, hyp) / n)
    return F.least(out, F.lit(1.0)) if capped else out


def improvement(before: Column, after: Column) -> Column:
    """Percent less than before; 0 where there was nothing."""
    return F.when(before > 0, (before - after) / before * 100).otherwise(0.0)


def grade(percent: Column) -> Column:
    """S, A, B, C, D at up to 10, 20, 35, 50 and 70 percent of errors, else F."""
    return F.when(percent <= 10, "S").when(percent <= 20, "A").when(percent <= 35, "B").when(percent <= 50, "C").when(percent <= 70, "D").when(percent.isNotNull(), "F")


def bucket(percent: Column) -> Column:
    """GOOD under 15 percent, FAIR under 30, else POOR."""
    return F.when(percent < 15, "GOOD").when(percent < 30, "FAIR").when(percent.isNotNull(), "POOR")


def confidence_level(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def segment_confidence(avg_logprob: Column, no_speech: Column) -> Column:
    """One plus the mean log probability, kept within 0 and 1, halved where silence is likely; 0.5 if unknown."""
    base = F.least(F.greatest(1 + avg_logprob, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.round(F.when(no_speech > 0.5, base * 0.5).otherwise(base), 3), F.lit(0.5))

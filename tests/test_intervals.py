import random

import numpy as np
import pytest

from turnmill.operators import intervals as I

SCHEMA = "file_id string, start double, end double, entity string, cell int"


def brute(spans):
    out = []
    for s, e in sorted(x for x in spans if x[0] < x[1]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(6))
def test_merge_on_line_equals_sweep(seed):
    rng = random.Random(seed)
    spans = [(a, min(256, a + rng.randint(0, 40))) for a in (rng.randrange(256) for _ in range(rng.randint(0, 25)))]
    lo, hi = (np.array([x[i] for x in spans], np.int64) for i in (0, 1))
    s, e = I.merge_on_line(lo, hi, bits=8)
    assert list(zip(s.tolist(), e.tolist())) == brute(spans)


def test_blocks_are_canonical():
    levels = I.dyadic_blocks(np.array([3]), np.array([13]), 8)
    blocks = [(k << n, (k + 1) << n) for n, b in enumerate(levels) for k in b.tolist()]
    assert sorted(blocks) == [(3, 4), (4, 8), (8, 12), (12, 13)]


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    g = sorted(map(tuple, I.gaps(df, "file_id", "start", "end").collect()), key=repr)
    p = sorted(map(tuple, I.periods(df, "file_id", "start", "end").collect()), key=repr)
    return g, p


def test_cases(spark):
    nan = float("nan")
    rows = [
        ("a", 0.0, 1.0, "x", 1), ("a", 1.0, 2.0, None, None), ("a", 0.5, 0.7, "x", 1), ("a", 0.5, 0.7, "x", 1),
        ("a", 3.0, 2.5, None, 0), ("a", None, 9.0, None, 0), ("a", 9.0, None, None, 0), ("a", nan, 5.0, None, 0), ("a", 4.0, 4.0, None, 0),
        ("a", 2.0004, 3.0, None, 0), ("a", 4.5, 5.0, None, 0), ("a", 3604.999, 3605.0, None, 0), ("a", 7205.0, 7206.0, None, 0), (None, 0.0, 1.0, None, 0), (None, 2.0, 3.0, None, 0),
        ("long", 0.0, 5000.0, None, 0), ("long", 5000.0, 5001.0, None, 0), ("long", 5002.0, 6000.0, None, 0), ("far", 1e12, 2e12, None, 0),
    ]
    g, p = found(spark, rows)
    assert g == sorted([("a", 3000, 4500), ("a", 5000, 3604999), (None, 1000, 2000), ("long", 5001000, 5002000)], key=repr)
    assert ("a", 0, 3000) in p and ("long", 0, 5001000) in p and ("long", 5002000, 6000000) in p


def test_empty(spark):
    assert found(spark, []) == ([], [])


def test_chunks_carry_a_split_run(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(s), s + rng.random() * 3, None, None) for s in (rng.randrange(3000) for _ in range(3000))]
    expect = found(spark, rows)
    monkeypatch.setattr(I, "CHUNK_ROWS", 50)
    batches = []
    import pyarrow as pa

    for f in "ab":
        cells = sorted((int(s * 1000 + 0.5) >> 20, int(s * 1000 + 0.5), int(e * 1000 + 0.5)) for k, s, e, *_ in rows if k == f)
        for c, s, e in cells:
            for cell in range(c, (e - 1 >> 20) + 1) if e > s else ():
                batches.append((f, cell, max(0, s - (cell << 20)), min(1 << 20, e - (cell << 20)), 0))
    batches.sort(key=lambda r: r[:2])
    arrow = [pa.RecordBatch.from_pydict(dict(zip(("entity", "cell", "lo", "hi", "reach"), map(list, zip(*batches[i : i + 17]))))) for i in range(0, len(batches), 17)]
    periods = [(b["entity"][i].as_py(), x["period_start"], x["period_end"]) for b in I._cell_summaries(iter(arrow)) for i in range(b.num_rows) for x in b["periods"][i].as_py()]
    merged = {}
    for f, s, e in sorted(periods):
        merged.setdefault(f, []).append((s, e))
    assert sorted((f, *x) for f, v in merged.items() for x in brute(v)) == sorted(expect[1])


def test_long_intervals_equal_brute_force(spark):
    rng = random.Random(9)
    cell = 1048.576
    rows = []
    for f in "uvw":
        for _ in range(60):
            a = rng.choice([rng.uniform(0, 60 * cell), cell * rng.randint(0, 60)])
            b = a + rng.choice([rng.uniform(0, 300), rng.uniform(0, 9 * cell), cell * rng.randint(1, 4)])
            rows.append((f, a, b, None, 0))
    rows += [("far", 1e12, 2e12, None, 0), ("far", -1e13, -5e12, None, 0), ("far", 1.5e12, 2.1e12, None, 0), ("inf", 0.0, float("inf"), None, 0)]
    spans = {}
    for f, a, b, *_ in rows:
        if f != "inf":
            spans.setdefault(f, []).append((int(np.floor(a * 1000 + 0.5)), int(np.floor(b * 1000 + 0.5))))
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((f, *x) for f, s in spans.items() for x in brute(s))
    assert sorted(map(tuple, I.periods(df, "file_id", "start", "end").collect())) == want
    gaps = sorted((f, p[1], q[0]) for f in spans for ps in [brute(spans[f])] for p, q in zip(ps, ps[1:]))
    assert sorted(map(tuple, I.gaps(df, "file_id", "start", "end", shorter_than=None).collect())) == gaps

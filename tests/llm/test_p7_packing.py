import random
from collections import Counter, defaultdict

from turnmill.llm import packing


def test_plan_uses_every_item_within_capacity():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.choice([10, 50, 300])
        h = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 400)))
        used, containers = Counter(), 0
        for items, times in packing.plan(h, cap):
            assert sum(s * n for s, n in items.items()) <= cap and times > 0
            containers += times
            for s, n in items.items():
                used[s] += n * times
        assert used == h and containers <= 2 * -(-sum(s * n for s, n in h.items()) // cap)


def test_complements():
    import numpy as np

    counts = np.zeros(21, int)
    for s in (3, 4, 4, 9):
        counts[s] += 1
    find = lambda gap: packing.Sums(counts).closing(counts, gap)
    assert find(9) == [9] and sorted(find(8)) == [4, 4]
    assert sorted(find(11)) == [3, 4, 4] and find(12) in ([9, 3], [3, 9])
    assert find(6) is None


def test_assignment(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 5, 5, 5, 7, 33, 64, 65, 200])) for i in range(600)] + [(1000, None), (1001, 6400)]
    df = spark.createDataFrame([(*r, 1) for r in sizes], "doc_id bigint, tokens int, rank int")
    out = packing.pack(df, [(1, 64), (2, 100)]).collect()
    for cid, cap in ((1, 64), (2, 100)):
        load, pieces = defaultdict(int), defaultdict(list)
        for r in out:
            if r.capacity_id == cid:
                load[r.container] += r.tokens
                pieces[r.doc_id].append(r.tokens)
        assert max(load.values()) <= cap
        for i, n in sizes:
            assert sum(pieces[i]) == (n or 0) and len(pieces[i]) == max(1, -(-(n or 0) // cap))
        assert len([c for c, n in load.items() if n]) <= -(-sum(n or 0 for _, n in sizes) // cap) * 1.15 + 1
    assert packing.pack(df.limit(0), [(1, 64)]).collect() == []


def test_index_stays_exact_while_counts_fall():
    import itertools

    import numpy as np

    for k in range(200):
        rng = random.Random(k)
        counts = np.zeros(41, np.int64)
        for _ in range(rng.randint(2, 9)):
            counts[rng.randint(1, 20)] += rng.randint(1, 3)
        index = packing.Sums(counts)
        while counts.any():
            rest = counts.copy()
            taken = rng.choice(np.flatnonzero(counts).tolist())
            rest[taken] -= 1  # of the container that is being filled
            items = [s for s in range(41) for _ in range(min(3, rest[s]))]
            gap = rng.randint(1, 40)
            there = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(items, n))
            got = index.closing(rest, gap)
            assert (got is not None) == there and (got is None or sum(got) == gap and all(got.count(s) <= rest[s] for s in got))
            for s in [taken, *(got or [])]:
                counts[s] -= 1

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from turnmill.llm import packing, personal, turns


def test_p1_takes_the_time_of_the_predecessor_across_blocks(spark):
    # 1,024 heads a block of arrivals; 2,048 to 3,071 is one without any time; 1,025 and 3,072 are spoken late
    bare = {1024, *range(2048, 3072)}
    late = {1025: 9000.0, 3072: 9001.0}
    rows = [("f", i, None if i in bare else late.get(i, float(i)), "말", "의사" if i in bare else "환자", "clash", 0) for i in range(3100)]
    df = spark.createDataFrame(rows, "file_id string, seq int, start double, text string, speaker string, n1 string, block int")
    codes = spark.createDataFrame([("doctor", 0), ("patient", 1)], "role string, diarizer_no int")
    assert sorted(r.seq for r in turns.turn_starts(df, codes).collect()) == [0, 1024, 1026, 2048, 3073]


def test_p7_finds_triples_beyond_the_first_256_thirds():
    counts = np.zeros(4097, np.int64)
    counts[[*range(1502, 2000, 2), *range(2002, 3000, 2)]] = 1
    counts[1000] = 3
    assert sorted(packing.Sums(counts).closing(counts, 3000)) == [1000, 1000, 1000]


def test_p7_triples_against_all_combinations():
    rng = random.Random(5)
    for _ in range(300):
        counts = np.zeros(61, np.int64)
        for _ in range(rng.randint(1, 12)):
            counts[rng.randint(1, 60)] = rng.randint(1, 3)
        items = [s for s in range(61) for _ in range(min(3, counts[s]))]
        gap = rng.randint(1, 60)
        there = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(items, n))
        got = packing.Sums(counts).closing(counts, gap)
        assert (got is not None) == there and (got is None or sum(got) == gap and all(got.count(s) <= counts[s] for s in got))


def test_p5_looks_at_every_text_with_a_find(spark):
    texts = [
        "neul7 앳 maru.test 로", "neul7 ( at ) maru.test", "neul7(AT)maru.test", "담당은 김온비님", "저는 김온비씨", "152, Teheran-ro", "공이 일이삼 사오육칠", "서류에 김온비, 박달솜", "Haeseul O 씨",
        "김온비 (웃음) 님", "바람결로 (웃음) 346로 택배", "010 (웃음) 1234 (웃음) 5678 네", "900101…1234567", "바람결로\t346로", "김온비 음... 님이",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    passed = {r.t for r in df.where(personal.suspect(F.col("t"))).collect()}
    assert [t for t in texts if personal.find(t) and t not in passed] == []
    assert sum(bool(personal.find(t)) for t in texts) >= 10

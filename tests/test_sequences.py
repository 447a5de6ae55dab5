import random

from pyspark.sql import functions as F

from turnmill.operators import blocked, folds, joins, roles, rules
from turnmill.operators import sequences as S


def rows(spark, n=200, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice("ab"), i, float(i), i + 1.5, rng.choice(["x", "y", None]), rng.choice(["p", None, None])) for i in range(n)]
    return data, spark.createDataFrame(data, "file_id string, seq int, start double, end double, speaker string, phase string")


def test_neighbours_and_counts_across_blocks(spark):
    data, df = rows(spark)
    small = df.withColumn("block", blocked.block_of(F.col("seq"), 7))
    got = {r.seq: r for r in blocked.running_count(blocked.neighbours(small, ["file_id"], "block", ["seq"], ["seq", "speaker"], after=True), ["file_id"], "block", ["seq"], F.col("speaker") == "x", "n").collect()}
    for f in "ab":
        mine = [d for d in data if d[0] == f]
        count = 0
        for i, d in enumerate(mine):
            count += d[4] == "x"
            r = got[d[1]]
            assert r.prev_seq == (mine[i - 1][1] if i else None) and r.next_seq == (mine[i + 1][1] if i + 1 < len(mine) else None) and r.n == count


def test_filled_across_blocks(spark):
    data, df = rows(spark, seed=2)
    got = {r.seq: r.filled for r in blocked.filled(df.withColumn("block", blocked.block_of(F.col("seq"), 5)), ["file_id"], "block", ["seq"], "phase", "filled").collect()}
    for f in "ab":
        mine = [d for d in data if d[0] == f]
        for i, d in enumerate(mine):
            back = [m[5] for m in mine[: i + 1] if m[5]]
            ahead = [m[5] for m in mine[i:] if m[5]]
            assert got[d[1]] == (back[-1] if back else ahead[0] if ahead else None)


def test_speaker_join_prefers_the_middle(spark):
    seg = spark.createDataFrame([("f", 1, 0.0, 2.0), ("f", 2, 10.0, 12.0), ("f", 3, 50.0, 50.02), ("g", 1, 0.0, 1.0)], "file_id string, seq int, start double, end double")
    turns = spark.createDataFrame([("f", 1, 1.0, 1.2, "A"), ("f", 2, 0.0, 2.0, "B"), ("f", 3, 11.5, 13.0, "C"), ("f", 4, 50.01, 50.05, "D")], "file_id string, ord int, start double, end double, speaker string")
    got = {(r.file_id, r.seq): r.speaker for r in joins.speaker_of_segments(seg, turns).collect()}
    assert got == {("f", 1): "A", ("f", 2): "C", ("f", 3): "D", ("g", 1): None}


def test_similar_words_against_all_pairs(spark):
    w = spark.createDataFrame([("심전도",), ("복통",), ("a",), (None,)], "word string")
    v = spark.createDataFrame([("쌈전도",), ("복부",), ("두통",), (None,)], "term string")
    got = {(r.word, r.term) for r in joins.similar_words(w, v).collect()}
    assert ("심전도", "쌈전도") in got and all(a != "a" for a, _ in got)


def test_exact_rules_in_order_with_hints(spark):
    rs = [{"id": "1", "wrong": "ab", "correct": "cd", "hints": []}, {"id": "2", "wrong": "cd", "correct": "ef", "hints": ["near"]}]
    df = spark.createDataFrame([("ab near",), ("ab" + " " * 40 + "near",), (None,), ("",)], "t string")
    got = [tuple(r.x) if r.x else None for r in df.select(rules.exact(F.col("t"), rs).alias("x")).collect()]
    assert got[0] == ("ef near", ["1", "2"]) and got[1][1] == ["1"] and got[3] == ("", [])


def test_pattern_rules(spark):
    rs = [{"id": "1", "pattern": "(a)(b", "correct": "x"}, {"id": "2", "pattern": r"(\d+)mg", "correct": r"\1 mg"}]
    assert spark.createDataFrame([("5mg",)], "t string").select(rules.patterns(F.col("t"), rs)).first()[0] == "5 mg"


def test_categories_follow_the_recursion(spark):
    rng = random.Random(4)
    words = [w for ws in roles.NOTE_WORDS.values() for w in ws] + ["", None, "안녕하세요", "감사합니다", "음"]
    data = [("f", i, " ".join(rng.choice(words) or "" for _ in range(rng.randint(1, 4))), rng.choice(["의사", "환자", None])) for i in range(9000)]
    df = spark.createDataFrame(data, "file_id string, seq int, text string, role string")
    got = {r.seq: (r.category, r.sure) for r in roles.categorised(df).collect()}
    prev = None
    for _, i, t, who in data:
        kind = {"의사": "doctor", "환자": "patient"}.get(who, "unknown")
        s = [round(sum(v for w, v in roles.NOTE_WORDS[c].items() if w in t) * roles.ROLE_WEIGHTS[kind][k], 4) + (c == prev) for k, c in enumerate(roles.CATEGORIES)]
        if not t.strip():
            want = ("unknown", 0.0)
        elif len(t) <= 50 and "안녕하세요" in t:
            want = ("greeting", 0.9)
        elif len(t) <= 60 and "감사합니다" in t:
            want = ("farewell", 0.9)
        elif sum(s) == 0:
            want = {"patient": ("S", 0.3), "doctor": ("P", 0.3)}.get(kind, ("unknown", 0.1))
        else:
            c = roles.CATEGORIES[s.index(max(s))]
            many = sum(w in t for w in roles.NOTE_WORDS[c]) >= 3
            want = (c, min(max(s) / sum(s) + 0.1 * many, 1.0))
        prev = want[0] if want[0] in roles.CATEGORIES else prev
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 6e-4, (i, t, got[i], want)


def test_shifted_rows_cross_short_blocks(spark):
    from turnmill.operators import blocked

    rng = random.Random(8)
    data = [("f", i, sorted(rng.choices(range(30), k=1))[0]) for i in range(100)]
    rows = spark.createDataFrame([(f, i, i // rng.choice([7])) for f, i, _ in data] + [("g", i, i) for i in range(9)], "file_id string, seq int, block int")
    got = {(r.file_id, r.seq): ([r[f"prev{k}"] and r[f"prev{k}"].seq for k in (1, 2, 3)], [r[f"next{k}"] and r[f"next{k}"].seq for k in (1, 2)]) for r in blocked.shifted(rows, ["file_id"], "block", ["seq"], ["seq"], 3, 2).collect()}
    assert len(got) == 109
    for (f, i), (before, after) in got.items():
        n = 100 if f == "f" else 9
        assert before == [i - k if i - k >= 0 else None for k in (1, 2, 3)] and after == [i + k if i + k < n else None for k in (1, 2)]


def test_chunk_fold_equals_plain_loop(spark):
    rng = random.Random(6)
    words = ["검사를 먼저 하고 약을", "약을 드시면 됩니다", "네", "검사를 먼저 하고 약을 드시면 됩니다", "하고 약을 드시면 됩니다", ""]
    data = [("f", i, s, s + rng.choice([0.5, 1.0, 4.0]), rng.choice(words)) for i, s in enumerate(sorted(rng.random() * 200 for _ in range(300)))]
    data += [("f", 900, None, 1.0, "x"), ("f", 901, 1.0, None, None)]
    df = spark.createDataFrame(data, "file_id string, seq int, start double, end double, text string")
    kept = []
    for r in data[:300]:
        if kept:
            t, p = r[4].strip(), kept[-1][4].strip()
            short, long = sorted((t, p), key=len)
            tails = any(p[-k:] == t[:k] for k in range(6, 13) if min(len(p), len(t)) >= k)
            if t and p and r[2] <= kept[-1][3] + 0.35 and (t == p or (len(short) >= 6 and short in long) or tails):
                continue
        kept.append(r)
    assert sorted(r.seq for r in folds.without_chunk_repeats(df).collect()) == [r[1] for r in kept] + [900, 901]


def test_overlap_fold_equals_plain_loop(spark):
    rng = random.Random(5)
    data = [("f", i, s, s + rng.choice([0.0, 1.0, 3.0]), "w" * rng.randint(0, 5)) for i, s in enumerate(sorted(rng.random() * 300 for _ in range(300)))]
    df = spark.createDataFrame(data, "file_id string, seq int, start double, end double, text string")
    kept = []
    for r in data:
        if kept and r[3] > r[2] and (min(kept[-1][3], r[3]) - max(kept[-1][2], r[2])) / (r[3] - r[2]) > 0.5:
            if len(r[4]) > len(kept[-1][4]):
                kept[-1] = r
            continue
        kept.append(r)
    assert sorted(r.seq for r in folds.without_overlaps(df).collect()) == [r[1] for r in kept]


def test_gaps_head_inner_tail(spark):
    df = spark.createDataFrame([("f", 1, 2.0, 3.0), ("f", 2, 4.0, 5.0), ("g", 1, 0.5, 1.0), ("g", 2, None, 1.0)], "file_id string, seq int, start double, end double")
    d = spark.createDataFrame([("f", 7.0), ("g", 2.0)], "file_id string, duration_s double")
    got = sorted((r.file_id, r.place, r.gap_start, r.gap_end) for r in S.time_gaps(df, d).collect())
    assert got == [("f", "head", 0.0, 2.0), ("f", "inner", 3.0, 4.0), ("f", "tail", 5.0, 7.0)]

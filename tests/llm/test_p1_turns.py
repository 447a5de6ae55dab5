from turnmill.llm import turns as T

SEG = "file_id string, seq int, start double, text string, speaker string, n1 string, block int"
CODES = [("doctor", 0), ("patient", 1), ("guardian", 2), ("nurse", 3)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SEG)
    codes = spark.createDataFrame(CODES, "role string, diarizer_no int")
    starts = sorted((r.file_id, r.seq) for r in T.turn_starts(df, codes).collect())
    turns = sorted((r.file_id, r.turn, r.first_seq, r.role, r.text) for r in T.turns(df, codes).collect())
    assert starts == sorted((f, s) for f, _, s, _, _ in turns)
    return turns


def test_cases(spark):
    nan = float("nan")
    got = run(spark, [
        ("a", 1, 0.0, "[00:00:01] 의사: 음, 안녕하세요. (웃음)", None),
        ("a", 2, 2.0, "네.", "?"), ("a", 2, 2.0, "네.", "?"),
        ("a", 3, 1.0, "어디가 아프세요?", "Dr."), ("a", 4, 3.0, "음음음. [noise]", "환​자"), ("a", 5, 3.0, None, "PT"), ("a", 6, 3.0, "", "PT"), ("a", 7, 3.0, "　", "PT"),
        ("a", 8, 5.0, "배가 아파요", "ＳＰＥＡＫＥＲ＿０１"), ("a", 9, 5.0, "어제부터요", "unknown"), ("a", 10, nan, "Nurse) 잠시만요", None), ("a", 11, 4.5, "보호자 - 제가 말할게요", "-"),
        (None, 1, 0.0, "x", "PT"), ("b", None, 0.0, "x", "PT"), ("c", 1, 0.0, "음 " * 5000, "PT"), ("d", 1, 0.0, "말 " * 5000, None),
    ])
    assert [t[1:4] for t in got if t[0] == "a"] == [(1, 1, "doctor"), (2, 11, "guardian"), (3, 8, "patient"), (4, 10, "nurse")]
    assert got[0][4] == "안녕하세요. 어디가 아프세요? 네."
    assert [t[1:4] for t in got if t[0] == "d"] == [(1, 1, None)] and not any(t[0] == "c" for t in got)


def test_runs_cross_blocks(spark):
    rows = [("f", i, i * 300.0, "말", "의사" if i // 7 % 2 else "환자") for i in range(3000)]
    assert [t[2] for t in run(spark, rows)] == list(range(0, 3000, 7))


def test_empty(spark):
    assert run(spark, []) == []


def test_conflicting_edges_are_dropped():
    # 0 and 2 have times against their arrival, 1 and 3 have none: 1 stays behind 0, and 1 -> 2 would close a cycle
    seq, start, cue = [0, 1, 2, 3], [50.0, None, 10.0, None], [None] * 4
    own = list(start)
    edges = T.constraints(seq, start, cue)
    assert (T.TIMING, 2, 0) in edges and (T.DIALOGUE, 1, 2) in edges
    kept = T.without_conflicts(edges, own, seq, None)
    assert (T.DIALOGUE, 1, 2) not in kept and (T.DIALOGUE, 0, 1) in kept and (T.DIALOGUE, 2, 3) in kept
    order, at = T.topological(seq, own, kept, None, None)
    assert order == [2, 3, 0, 1] and at == [50.0, 50.0, 10.0, 10.0]
    assert T.topological([4, 5], [None, None], [(T.DIALOGUE, 0, 1)], 7.0, None) == ([0, 1], [7.0, 7.0])
    assert T.topological([4, 5], [None, None], [(T.DIALOGUE, 0, 1)], None, 9.0) == ([0, 1], [9.0, 9.0])
    assert T.topological([4], [None], [], None, None) == ([0], [0.0])


def test_order_is_topological_for_any_graph():
    import random

    for k in range(300):
        rng = random.Random(k)
        n = rng.randint(1, 30)
        start = [None if rng.random() < 0.4 else float(rng.randint(0, 9)) for _ in range(n)]
        cue = [float(rng.randint(0, 9)) if s is None and rng.random() < 0.3 else None for s in start]
        own = [c if s is None else s for s, c in zip(start, cue)]
        kept = T.without_conflicts(T.constraints(list(range(n)), start, cue), own, list(range(n)), None)
        order, at = T.topological(list(range(n)), own, kept, None, None)
        place = {u: i for i, u in enumerate(order)}
        assert sorted(order) == list(range(n)) and all(place[u] < place[v] for _, u, v in kept)
        assert order == sorted(range(n), key=lambda u: (at[u], u))


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [("f", i, None if rng.random() < 0.3 else float(rng.randint(0, 40)), "[00:00:07] 말" if rng.random() < 0.1 else "말", rng.choice(["의사", "환자", None])) for i in range(120)]
    want = None
    for size in (1, 7, 64, 1024):
        monkeypatch.setattr(T, "SEQ_BLOCK", size)
        got = run(spark, rows)
        want = want or got
        assert got == want
    moved = run(spark, [(f, i + 1000, *r) for f, i, *r in rows])
    assert [t[2] - 1000 for t in moved] == [t[2] for t in want]

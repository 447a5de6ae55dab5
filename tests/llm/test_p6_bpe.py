import random

import pytest

from turnmill.llm import bpe

try:
    RANKS = bpe.load_ranks()
except (FileNotFoundError, ImportError):
    RANKS = None
pytestmark = pytest.mark.skipif(RANKS is None, reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=RANKS, special_tokens={})


def test_random_texts(reference):
    e, rng = bpe.encoder(), random.Random(1)
    letters = list("aaabeinrstE0 \t\n'<|>") + list("가한글éß😀�_=-.")
    for _ in range(1500):
        t = "".join(rng.choices(letters[: rng.randint(2, len(letters))], k=rng.randint(1, 80)))
        ids = e.encode(t)
        assert ids == reference.encode_ordinary(t) and b"".join(e.bytes_of[i] for i in ids).decode() == t


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "=" * 9000, " " * 9000, "가" * 9000, "<|endoftext|>"])
def test_long_pieces(reference, text):
    assert bpe.encoder().encode(text) == reference.encode_ordinary(text)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "", None), (3, " ", None), (4, "hello", None), (4, "hello", None), (None, "x", None)], "doc_id bigint, text string, ids array<int>")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode(df).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2)] == [(1, []), (2, [])] and len(got) == 6
    assert {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()}[1] == 0
    assert bpe.encode(df.limit(0)).collect() == []

"""Problem 6: exact ids of a byte-level pair encoding, computed prefix by prefix.

The encoding of every prefix of a piece ends in one certain token. For the
prefix of length i it is the longest vocabulary token ``t`` that ends there and
whose join with the last token of the prefix before it is one that the merges
would leave standing. Candidates for ``t`` are the suffixes of the prefix that
are tokens; a suffix automaton (all vocabulary tokens as a trie with failure
links, from the C library) names the longest one at each position, and the
chain of shorter token suffixes is tabulated per token. Whether a pair of
tokens stays apart is decided by undoing merges from both sides. Back-pointers
from the end give the ids. Work is linear in the text for any text.

Text is first cut into pieces by the vocabulary's own pattern, as its merges
never cross them; a bounded cache holds the ids of pieces seen.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Where the vocabulary files lie; a parameter of every operator here.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: The pattern that cuts text into pieces, a fixed value of this vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces held by the cache of one worker, and the longest piece that is held.
CACHE_PIECES = 400_000
CACHE_CHARS = 64


class PrefixEncoder:
    """Encodes pieces by one table per prefix; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # token -> its longest proper suffix that is a token, or -1
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the two tokens that its last merge joined
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}
        self.cut = regex.compile(PIECES)

    def _shorter(self, token: int) -> int:
        found = self.shorter.get(token)
        if found is None:
            b = self.bytes_of[token]
            found = next((self.ranks[b[k:]] for k in range(1, len(b)) if b[k:] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def _parts(self, token: int) -> tuple[int, int]:
        """The pair whose merge makes this token, or (token, token) for a single byte."""
        found = self.parts.get(token)
        if found is None:
            b = self.bytes_of[token]
            found = (token, token)
            if len(b) > 1:
                ids = [self.ranks[b[k : k + 1]] for k in range(len(b))]
                while len(ids) > 2:  # merge as training did, stopping before the last merge
                    best, at = min((self._joined(ids[k], ids[k + 1]), k) for k in range(len(ids) - 1))
                    ids[at : at + 2] = [best]
                found = (ids[0], ids[1])
            self.parts[token] = found
        return found

    def _joined(self, left: int, right: int) -> int:
        return self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 40)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges, latest first. A join across the border that would have come before the merges
        # undone so far breaks the pair; ``limit`` is the rank from which joins come too late. Among
        # equal ranks the leftmost join comes first, so the right token's own rank is still in time.
        parts, limit = self._parts, 1 << 40
        while True:
            if self._joined(left, right) < limit:
                return False
            for side in (0, 1) if left > right else (1, 0):
                if side == 0:
                    limit, inner = left, parts(left)[1]
                    if inner != left:
                        left = inner
                        break
                else:
                    limit, inner = right + 1, parts(right)[0]
                    if inner != right:
                        right = inner
                        break
            else:
                return True

    def encode_bytes(self, b: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(b)
        if whole is not None and len(b) <= 2:
            return [whole]
        n = len(b)
        last = [-1] * (n + 1)
        bytes_of, compatible, shorter = self.bytes_of, self.compatible, self._shorter
        for end, token in self._longest(b):
            i = end + 1
            while token >= 0:
                start = i - len(bytes_of[token])
                if start == 0 or compatible(last[start], token):
                    break
                token = shorter(token)
            last[i] = token
        ids = []
        while n > 0:
            ids.append(last[n])
            n -= len(bytes_of[last[n]])
        ids.reverse()
        return ids

    def _longest(self, b: bytes) -> Iterator[tuple[int, int]]:
        """(end, longest token ending there); the automaton reports the longest match of an end first."""
        before = -1
        for end, token in self.automaton.iter(b.decode("latin-1")):
            if end != before:
                before = end
                yield end, token

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache, extend = self.cache, out.extend
        for piece in self.cut.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            extend(ids)
        return out


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def load_ranks(directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file as token bytes -> id; falls back on the installed package of the files."""
    path = f"{directory}/{name}.tiktoken"
    try:
        lines = open(path, "rb").read().splitlines()
    except FileNotFoundError:
        lines = open(importlib.import_module("public_tokenizers").path(f"{name}.tiktoken"), "rb").read().splitlines()
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line)}


def encoder(directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> PrefixEncoder:
    """The encoder of this worker, built once."""
    if (directory, name) not in _ENCODERS:
        _ENCODERS[directory, name] = PrefixEncoder(load_ranks(directory, name))
    return _ENCODERS[directory, name]


def ids_column(column, directory: str = VOCABULARY_DIR, name: str = VOCABULARY):
    """A column of token ids; null and empty texts have the empty list."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(directory, name)
        return pd.Series([e.encode(t) if t else [] for t in texts], dtype=object)

    return ids(column)


def encode(df: DataFrame, id_col: str = "doc_id", text: str = "text", directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """(id, ids): every row once; null and empty texts come out with an empty list."""
    return df.select(df[id_col], ids_column(df[text], directory, name).alias("ids"))


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """(id, tokens): sizes only, so that no id list is shuffled."""

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        e = encoder(directory, name)
        return pd.Series([len(e.encode(t)) if t else 0 for t in texts], dtype="int32")

    return df.select(df[id_col], size(df[text]).alias("tokens"))

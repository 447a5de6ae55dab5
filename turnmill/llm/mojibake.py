"""Problem 8: text decoded with the wrong encoding, found and restored.

A noisy channel: a text is written with one encoding and read with another. A
channel is a pair (read with, written with). For each token that isn't plain
ASCII the bytes behind it are laid out under every channel; a replacement
character, or a question mark where the reading encoding has holes, is a
wildcard for a lost byte. Every valid reading of these byte lattices is weighed
by the corpus: words by how often they occur (a count-min sketch of fixed size),
unknown words by their characters. Lost bytes are filled by a list Viterbi search
of the lattice, which keeps the ``LISTED`` likeliest ways to each byte and is exact
for as many readings; words then choose among them. A Viterbi pass over the tokens
of a text picks, with a cost for changing the channel, the likeliest sequence of
clean and damaged spans; the pass is repeated for texts damaged twice. Every text
that isn't plain ASCII is decoded: no look at its characters decides beforehand.

A replacement character stands for a byte that was lost on the way, so a text
that holds one is garbled whatever else is there; where more than half of a
token's bytes are lost, no reading of it is weighed and the damage stays. Null and
empty texts are never garbled. Escapes, accents, foreign scripts and symbols stay,
as under no channel they read better than as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are counted in so many rows of so many hashed buckets.
ROWS, BUCKETS = 3, 1 << 18
#: Ways to each byte that are kept while the wildcards of a token are filled.
LISTED = 64
#: Lead bytes that a lost one can be: accented letters, signs, kana, ideographs and Korean.
LEADS = (0x3F, 0xC2, 0xC3, 0xCE, 0xD0, 0xD1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xEB, 0xEC, 0xED, 0xF0)
#: Cost of entering or leaving a channel, in nats.
SWITCH = 2.0
#: What each sequence of bytes that is valid UTF-8 without a lost byte tells against chance, in nats.
VALID = 2.0
TOKENS_CACHED = 200_000
#: Characters that are counted at once, but for those of one text.
PART = 1 << 20
ROUNDS = 3
LOST = "\ufffd"

_WORD = regex.compile(r"[\p{L}\p{M}]+")
#: Whole tokens are counted too where they hold such characters, as signs belong to no word.
_MARKED = regex.compile(r"[\x80-\u10ff\u1200-\uabff]")
#: Spans between blanks that hold a character above ASCII; a text without blanks is cut after long stretches at punctuation.
_TOKEN = regex.compile(r"[^ \t\r\n]*[^\x00-\x7f](?:[^ \t\r\n]{0,400}(?=[ \t\r\n]|\Z)|[^ \t\r\n]{0,400}[!-/:-@\[-`{-~]|[^ \t\r\n]{0,400})")
#: Bytes that windows-1252 leaves undefined; some readers lose them to a question mark, which may also be one.
_HOLES = (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x3F)


def buckets(word: str) -> tuple[int, ...]:
    """The bucket of a word in each row."""
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
    return tuple((h >> 18 * r) & (BUCKETS - 1) for r in range(ROWS))


class Language:
    """How likely words and characters are in the corpus."""

    def __init__(self, words: np.ndarray, chars: dict[str, int]):
        n, m = max(1, int(words[0].sum())), max(1, sum(chars.values()))
        self.words = words
        # buckets are shared: a word counts as known only well above what an ordinary bucket holds
        self.least = max(3, 2 * int(np.median(words)))
        self.log_n, self.floor = math.log(n), math.log(0.5 / m)
        self.chars = {c: math.log(k / m) for c, k in chars.items()}
        self.known: dict[str, float] = {}
        self.fills: dict[tuple, list[tuple[float, str]]] = {}

    def char(self, c: str) -> float:
        return self.chars.get(c, self.floor)

    def seen(self, w: str) -> int:
        """How often the word occurs, or little more."""
        return min(int(self.words[r, k]) for r, k in enumerate(buckets(w)))

    def word(self, w: str) -> float:
        found = self.known.get(w)
        if found is None:
            spelled = sum(map(self.char, w)) - 2.0
            seen = self.seen(w)
            found = max(spelled, math.log(seen) - self.log_n - 1.0) if seen >= self.least else spelled
            if len(self.known) > TOKENS_CACHED:
                self.known.clear()
            self.known[w] = found
        return found

    def filled(self, pattern: tuple[int | None, ...], fills: tuple[int, ...] | None) -> list[tuple[float, str]]:
        """The likeliest characters of one UTF-8 sequence with lost bytes, best first; none if it can't be one."""
        key = (pattern, fills)
        found = self.fills.get(key)
        if found is None:
            n, found = len(pattern), []
            leads = (pattern[0],) if pattern[0] is not None else (fills or LEADS)
            trails = fills or tuple(range(0x80, 0xC0))
            for lead in leads:
                if _WIDTH[lead] != n:
                    continue
                options = [bytes([lead])]
                for x in pattern[1:]:
                    options = [o + bytes([y]) for o in options for y in ((x,) if x is not None else trails) if 0x80 <= y < 0xC0]
                for o in options:
                    try:
                        c = o.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    found.append((self.char(c) if c > "\x7f" else 0.0, c))
            found = sorted(found, reverse=True)[:LISTED]
            self.fills[key] = found
        return found

    def paired(self, pattern: tuple[int | None, ...], fills: tuple[int, ...] | None) -> list[tuple[float, str]]:
        """The likeliest characters of one or two bytes of cp949 with lost bytes, best first."""
        key = ("cp949", pattern)
        found = self.fills.get(key)
        if found is None:
            found = []
            if len(pattern) == 1:
                lead = (pattern[0],) if pattern[0] is not None else ()
                found = [(0.0, chr(x)) for x in lead if x < 0x80]
            else:
                for lead in (pattern[0],) if pattern[0] is not None else range(0x81, 0xFF):
                    for trail in (pattern[1],) if pattern[1] is not None else range(0x41, 0xFF):
                        c = bytes((lead, trail)).decode("cp949", "ignore")
                        if len(c) == 1 and c > "\x7f":
                            found.append((self.char(c), c))
            found = sorted(found, reverse=True)[:LISTED]
            self.fills[key] = found
        return found

    def text(self, t: str) -> float:
        score, at = 0.0, 0
        for m in _WORD.finditer(t):
            if m.start() > at:
                score += self._rest(t[at : m.start()])
            score += self.word(m.group())
            at = m.end()
        score += self._rest(t[at:])
        if _MARKED.search(t) and (seen := self.seen(t)) >= self.least:
            score = max(score, math.log(seen) - self.log_n - 1.0)
        return score

    def _rest(self, s: str) -> float:
        return sum(self.char(c) for c in s if c > "\x7f")


def _narrow(codec: str, holes: bool):
    """Text -> bytes of a one-byte encoding, None for a lost byte; None if it can't have been read with it."""
    back: dict[str, int] = {chr(b): b for b in range(256)}
    for b in range(0x80, 0x100):
        try:
            back[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass

    def encode(t: str) -> list[int | None] | None:
        out: list[int | None] = []
        for c in t:
            b = back.get(c)
            if b is None:
                if c != LOST:
                    return None
            elif holes and c == "?" and out and (out[-1] is None or out[-1] >= 0x80):
                b = None
            out.append(b)
        return out

    return encode


def _korean(t: str) -> list[int | None] | None:
    out: list[int | None] = []
    for c in t:
        if c == LOST:
            out.append(None)
            continue
        try:
            out.extend(c.encode("cp949"))
        except UnicodeEncodeError:
            return None
    return out


def _unicode(t: str) -> list[int | None] | None:
    out: list[int | None] = []
    for c in t:
        if c == LOST:
            out.append(None)
        else:
            out.extend(c.encode("utf-8", "replace"))
    return out


_WIDTH = [1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [0] * 11


def _searched(b: list[int | None], language: Language, widths: tuple[int, ...], options, fills) -> str | None:
    """List Viterbi over the bytes: the likeliest ways to each one by characters, of the whole ones the likeliest by words."""
    ways: dict[int, list[tuple[float, str]]] = {0: [(0.0, "")]}
    for at in range(len(b)):
        here = ways.pop(at, None)
        if not here:
            continue
        here = sorted(here, reverse=True)[:LISTED]
        for n in widths:
            if at + n > len(b):
                break
            best = options(tuple(b[at : at + n]), fills)
            if best:
                ways.setdefault(at + n, []).extend((score + s, t + c) for s, c in best for score, t in here)
    ended = sorted(ways.get(len(b), []), reverse=True)[:LISTED]
    return max((t for _, t in ended), key=language.text, default=None)


def _as_utf8(b: list[int | None], language: Language, fills: tuple[int, ...] | None) -> str | None:
    """The likeliest UTF-8 text of the bytes; ``fills`` are the bytes that a lost one can be (any if None)."""
    if None in b:
        return _searched(b, language, (1, 2, 3, 4), language.filled, fills)
    try:
        return bytes(b).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _as_korean(b: list[int | None], language: Language, fills: tuple[int, ...] | None) -> str | None:
    if None in b:
        return _searched(b, language, (1, 2), language.paired, fills)
    try:
        return bytes(b).decode("cp949")
    except UnicodeDecodeError:
        return None


#: name -> (bytes behind what was read, reading of these bytes, what a lost byte can be)
CHANNELS = {
    "windows-1252 as utf-8": (_narrow("cp1252", True), _as_utf8, _HOLES),
    "mac-roman as utf-8": (_narrow("mac_roman", False), _as_utf8, None),
    "windows-1251 as utf-8": (_narrow("cp1251", True), _as_utf8, (0x98, 0x3F)),
    "cp949 as utf-8": (_korean, _as_utf8, None),
    "windows-1252 as cp949": (_narrow("cp1252", False), _as_korean, None),
    "utf-8 as cp949": (_unicode, _as_korean, None),
}
_NAMES = ["", *CHANNELS]


class Decoder:
    """Viterbi over the tokens of a text."""

    def __init__(self, language: Language):
        self.language = language
        self.cache: dict[str, list[tuple[int, float, str]]] = {}

    def readings(self, token: str) -> list[tuple[int, float, str]]:
        """(channel, score, text) of every reading that is no worse than hopeless."""
        found = self.cache.get(token)
        if found is None:
            found = [(0, self.language.text(token), token)]
            for k, (encode, decode, fills) in enumerate(CHANNELS.values(), 1):
                b = encode(token)
                if b is None or (None in b and sum(x is None for x in b) * 2 > len(b)):
                    continue
                t = decode(b, self.language, fills)
                if t is None or t == token or LOST in t:
                    continue
                told = VALID * sum(c > "\x7f" for c in t) if decode is _as_utf8 and None not in b else 0.0
                best = (self.language.text(t) + told, t)
                for _ in range(ROUNDS - 1):  # damaged more than once on the same way
                    again = encode(t)
                    more = again and None not in again and decode(again, self.language, fills)
                    if not more or more == t or LOST in more:
                        break
                    t = more
                    best = max(best, (self.language.text(t) + told, t))
                found.append((k, *best))
            if len(self.cache) > TOKENS_CACHED:
                self.cache.clear()
            self.cache[token] = found
        return found

    def once(self, text: str) -> tuple[str, bool]:
        spans = list(_TOKEN.finditer(text))
        if not spans:
            return text, False
        options = []
        for m in spans:
            options.append(self.readings(m.group()))
        if all(len(o) == 1 for o in options):
            return text, False
        score, back = {0: 0.0}, []
        for o in options:
            top = max(score, key=score.get)
            new, came = {}, {}
            for k, s, _ in o:
                stay, move = score.get(k, -math.inf), score[top] - SWITCH
                came[k] = k if stay >= move else top
                new[k] = max(stay, move) + s
            score = new
            back.append(came)
        k = max(score, key=lambda x: score[x] - (SWITCH if x else 0.0))
        out, end = [], len(text)
        for m, o, came in zip(reversed(spans), reversed(options), reversed(back)):
            out.append(text[m.end() : end])
            out.append(next(t for j, _, t in o if j == k))
            end, k = m.start(), came[k]
        out.append(text[:end])
        new_text = "".join(reversed(out))
        return new_text, new_text != text

    def restore(self, text: str) -> tuple[str, bool]:
        garbled = LOST in text
        for _ in range(ROUNDS):
            text, changed = self.once(text)
            if not changed:
                break
            garbled = True
        return text, garbled


def language_of(df: DataFrame, text: str) -> tuple[np.ndarray, dict[str, int]]:
    """Word counts by bucket and character counts over all texts; both tables have a fixed bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chars = np.zeros((ROWS, BUCKETS), np.int64), np.zeros(0x110000, np.int64)
        for b in batches:
            pieces: Counter[str] = Counter()
            held, size = [], 0
            for text in b.column(0):
                t = text.as_py()
                if not t:
                    continue
                held.append(t)
                size += len(t)
                if size > PART:  # a batch of long texts isn't joined as a whole
                    chars += _characters(held)
                    held, size = [], 0
                for w, n in Counter(t.split()).items():
                    for m in _WORD.findall(w):
                        pieces[m] += n
                    if len(w) <= 40 and _MARKED.search(w):
                        pieces[w] += n
                if len(pieces) > TOKENS_CACHED:
                    _add(words, pieces)
            chars += _characters(held)
            _add(words, pieces)
        w, c = np.flatnonzero(words), np.flatnonzero(chars)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(w), np.int32), np.ones(len(c), np.int32)])),
                pa.array(np.concatenate([w, c]).astype(np.int32)),
                pa.array(np.concatenate([words.ravel()[w], chars[c]])),
            ],
            ["kind", "k", "n"],
        )

    t = df.select(text).mapInArrow(count, "kind int, k int, n bigint").groupBy("kind", "k").agg(F.sum("n").alias("n")).toArrow()
    kind, k, n = (t.column(c).to_numpy() for c in ("kind", "k", "n"))
    words = np.zeros(ROWS * BUCKETS, np.int64)
    words[k[kind == 0]] = n[kind == 0]
    return words.reshape(ROWS, BUCKETS), {chr(c): int(x) for c, x in zip(k[kind == 1], n[kind == 1])}


def _characters(texts: list[str]) -> np.ndarray:
    return np.bincount(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), minlength=0x110000)


def _add(words: np.ndarray, pieces: Counter[str]) -> None:
    for w, n in pieces.items():
        for r, k in enumerate(buckets(w)):
            words[r, k] += n
    pieces.clear()


def restored(df: DataFrame, text: str = "text", to: str = "restored", flag: str = "garbled", lost: str = "beyond_repair") -> DataFrame:
    """``df`` with the restored text, whether anything was garbled, and whether damage is left in it."""
    shared = df.sparkSession.sparkContext.broadcast(language_of(df, text))
    kept: dict[int, Decoder] = {}

    @F.pandas_udf("restored string, garbled boolean")
    def fix(texts: pd.Series) -> pd.DataFrame:
        d = kept.get(0) or kept.setdefault(0, Decoder(Language(*shared.value)))
        return pd.DataFrame([d.restore(t) if t and not t.isascii() else (None, False) for t in texts], columns=["restored", "garbled"])

    out = df.withColumn("__fixed", fix(F.col(text)))  # plain ASCII comes back as null, not copied
    out = out.withColumn(to, F.coalesce(F.col("__fixed.restored"), F.col(text))).withColumn(flag, F.col("__fixed.garbled")).drop("__fixed")
    return out.withColumn(lost, F.coalesce(F.col(to).contains(LOST), F.lit(False)))

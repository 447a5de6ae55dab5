"""Problem 4: one consistent form for texts that look the same.

Code points and short strings that look alike are joined into transitive classes
by union-find: a character with its width and compatibility form, be it one
character or a string; letters and signs of several scripts that share a shape;
kinds of space; and a letter with marks, in every composition that occurs, with
the same marks on every letter of the same shape. Only characters and strings
that occur in the corpus are looked at. Characters are at most one row a code
point; of the strings those count that are one character in some class, so both
tables are bounded by Unicode.

Each class has a plain member, in which no other class has a part, and a
representative, its most frequent member. One automaton rewrites, leftmost and
longest first, every member by the plain one until nothing changes; classes that
overlap ("ffi", letters under marks) meet there. A second automaton puts the
representatives in. Characters without any shape are rewritten to nothing.

A different case, accent, digit, word or punctuation mark stays different.
Null texts stay null; empty and blank texts are ordinary texts.
"""

from __future__ import annotations

import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters of the same shape, in pairs.
SAME_SHAPE = {
    "АВЕЅІЈКМНОРСТХУӀҮԌԜ": "ABESIJKMHOPCTXYIYGW",
    "аеорсухіјѕһԁԛԝѵӏ": "aeopcyxijshdqwvl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "ονιαρϲϳ": "oviapcj",
    "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ": "ABCDEGHJKLMPRSTVWZ",
    "ոսօհցզՍՕ": "nuohgqUO",
    "ɑɡ": "ag",
}
#: Signs of one shape that no compatibility form joins.
SAME_SIGN = {
    "‐‑⁃−﹣": "-----",
    "‘’‛′＇": "'''''",
    "“”‟″": '""""',
    "․": ".",
    "‚": ",",
    "∶ː꞉": ":::",
    "⁄∕": "//",
    "∙⋅・･ㆍ‧": "······",
    "˗": "-",
    "∼〜": "~~",
    "ǃ": "!",
    "µ": "μ",
    "º˚": "°°",
    "×": "×",
}
#: Compatibility forms that look different from what they stand for.
_NOT_ALIKE = {"super", "sub", "fraction", "circle"}
_MARK = {"Mn", "Mc", "Me"}


class Classes:
    """Union-find over strings; the root of a class is arbitrary, the representative is chosen later."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def invisible(c: str) -> bool:
    """Characters without a shape: formats, fillers and controls other than tab and line ends."""
    k = ud.category(c)
    return k == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or (k == "Cc" and c not in "\t\n\r\v\f\x85") or 0xFE00 <= ord(c) <= 0xFE0F


def _compatible(c: str) -> str | None:
    """The compatibility form if it looks the same."""
    d = ud.decomposition(c)
    if d.startswith("<") and d[1:].split(">")[0] in _NOT_ALIKE:
        return None
    form = ud.normalize("NFKC", c)
    return form if form != c and form.strip() else None


#: Letters with marks, and conjoining letters of Korean: strings that can be one character.
_UNIT = regex.compile(r"[\u1100-\u1112][\u1161-\u1175][\u11A8-\u11C2]?|[가-힣][\u11A8-\u11C2]|\P{M}\p{M}+")
#: No character is composed of more; longer strings of marks are put in canonical order as they are met.
MOST_PARTS = 4
_LONG = regex.compile(rf"\P{{M}}\p{{M}}{{{MOST_PARTS},}}")


class Forms:
    """Classes over the characters and strings that occur, with the plain member of each."""

    def __init__(self, characters: set[str], strings: set[str]):
        self.classes = Classes()
        shapes = {a: b for t in (SAME_SHAPE, SAME_SIGN) for k, v in t.items() for a, b in zip(k, v)}
        self.root: dict[str, str] = {}
        for a, b in shapes.items():
            self.classes.union(a, b)
            self.root[a] = b
        self.hidden = {c for c in characters if invisible(c)}
        for c in characters - self.hidden:
            if ud.category(c) == "Zs":
                self.classes.union(c, " ")
            elif self.plain(c) != c:
                self.classes.union(c, self.plain(c))
        for u in strings:
            apart = ud.normalize("NFD", "".join(self.root.get(x, x) for x in u))
            # a hidden character in between can leave a string composed in part
            for x in {u, apart, *(ud.normalize("NFC", apart[:i]) + apart[i:] for i in range(2, len(apart)))}:
                if self.plain(x) != x:
                    self.classes.union(x, self.plain(x))

    def plain(self, u: str) -> str:
        """The plain member of the class of a character, or of a letter with marks."""
        if len(u) == 1:
            if ud.category(u) == "Zs":
                return " "
            form = _compatible(u)
            if form is not None:
                return "".join(map(self.plain, form)) if form != u else u
        parts = [self.root.get(x, x) for x in ud.normalize("NFD", u)]
        return ud.normalize("NFC", "".join(parts))

    def of_strings(self) -> list[str]:
        """Members of more than one character."""
        return [x for x in self.classes.parent if len(x) > 1]


class _Alone(dict):
    """Table for ``str.translate``: each character's plain member, nothing for one without a shape."""

    def __init__(self) -> None:
        self.forms = Forms(set(), set())

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "" if invisible(c) else self.forms.plain(c)
        return self[code]


class Rewriter:
    """Greedy rewriting by automata: members to the plain ones until nothing changes, then those to the most frequent ones."""

    def __init__(self, frequency: dict[str, int]):
        forms = Forms({x for x in frequency if len(x) == 1}, {x for x in frequency if len(x) > 1 and _UNIT.fullmatch(x)})
        plain, chosen = {c: "" for c in forms.hidden}, {}
        for members in forms.classes.members().values():
            key = forms.plain(members[0])
            plain |= {m: key for m in members if m != key}
            best = max(members, key=lambda m: (frequency.get(m, 0), m == key, m))
            if best != key:
                chosen[key] = best
        # a part of a string that stays may be rewritten on its own, so a representative is final only among the chosen
        self.plain, self.chosen = self._automaton(plain), self._automaton(chosen)
        self.patterns = [*plain, *chosen]
        self.empty = not self.patterns

    @staticmethod
    def _automaton(patterns: dict[str, str]) -> ahocorasick.Automaton | None:
        if not patterns:
            return None
        a = ahocorasick.Automaton()
        for k, v in patterns.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        return a

    @staticmethod
    def _once(automaton: ahocorasick.Automaton | None, text: str) -> str:
        if automaton is None:
            return text
        out, at = [], 0
        for end, (n, to) in automaton.iter_long(text):
            out.append(text[at : end + 1 - n])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        if text is None or self.empty:
            return text
        if _LONG.search(text):
            text = ud.normalize("NFC", text)
        # rewritten characters can complete a string, so the pass is repeated until nothing changes
        while (new := self._once(self.plain, text)) != text:
            text = new
        return self._once(self.chosen, text)


#: Characters that are counted at once, but for those of one text.
PART = 1 << 20


def frequencies(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How often each character, and each string that a class can hold, occurs in the columns.

    At most one row a code point and one a composed form reaches the driver. Strings that stand for one
    character (as "mg" for the sign of a milligram) are known when the characters are, so they are counted in a
    second pass, and only where such characters occur.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, units, alone = np.zeros(0x110000, np.int64), Counter(), _Alone()
        held, size = [], 0
        for b in batches:
            for col in b.columns:
                for value in col:
                    t = value.as_py()
                    if not t:
                        continue
                    held.append(t)
                    size += len(t)
                    if not t.isascii():
                        units.update(u for u in _UNIT.findall(t) if len(u) <= MOST_PARTS)
                        # strings that come about when the characters are rewritten
                        for u in _UNIT.findall(t.translate(alone)):
                            units[u] += 0
                    if size > PART:
                        total += _characters(held)
                        held, size = [], 0
        total += _characters(held)
        at = np.flatnonzero(total)
        # a string that no class changes stays where it is
        forms = Forms(set(), set())
        kept = {u: n for u, n in units.items() if len(u) <= MOST_PARTS and forms.plain(u) != u}
        names = [*map(chr, at), *kept]
        yield pa.RecordBatch.from_arrays([pa.array([c.encode("utf-8", "surrogatepass") for c in names], pa.binary()), pa.array([*total[at].tolist(), *kept.values()], pa.int64())], ["c", "n"])

    def summed(rows: DataFrame) -> dict[str, int]:
        return {bytes(r.c).decode("utf-8", "surrogatepass"): r.n for r in rows.groupBy("c").agg(F.sum("n").alias("n")).collect()}

    texts = df.select(*columns)
    found = summed(texts.mapInArrow(count, "c binary, n bigint"))
    forms = Forms({c for c in found if len(c) == 1}, set())
    strings = [x for x in forms.of_strings() if not _UNIT.fullmatch(x) and x not in found]
    if not strings:
        return found

    def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(strings, 0)
        for b in batches:
            for col in b.columns:
                for value in col:
                    t = value.as_py()
                    if t:
                        for x in strings:
                            total[x] += t.count(x)
        yield pa.RecordBatch.from_arrays([pa.array([x.encode() for x in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["c", "n"])

    return found | {c: n for c, n in summed(texts.mapInArrow(count_strings, "c binary, n bigint")).items() if n}


def _characters(texts: list[str]) -> np.ndarray:
    return np.bincount(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000)


def rewritten(df: DataFrame, columns: list[str], frequency: dict[str, int], suffix: str = "") -> DataFrame:
    """``df`` with the columns (named with ``suffix``) in their consistent form."""
    shared = df.sparkSession.sparkContext.broadcast(frequency)  # at most one entry a code point
    kept: dict[int, Rewriter] = {}

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        r = kept.get(0) or kept.setdefault(0, Rewriter(shared.value))
        return texts.map(r, na_action="ignore")

    # every pattern ends in one of these; a text without any is surely untouched
    patterns = Rewriter(frequency).patterns
    risky = "".join(f"\\x{{{ord(c):X}}}" for c in sorted({k[-1] for k in patterns}))
    out = df
    for c in columns:
        # the function runs on every row that reaches it, so rows without a pattern pass it as null
        new = F.coalesce(rewrite(F.when(F.col(c).rlike(f"[{risky}]"), F.col(c))), F.col(c)) if risky else F.col(c)
        out = out.withColumn(c + suffix, new)
    return out


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns rewritten to the form in which texts that look the same are equal."""
    return rewritten(df, columns, frequencies(df, columns))


def alike_but_different(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Keys of rows whose two texts differ as stored but have one consistent form; null equals nothing."""
    frequency = frequencies(df, [a, b])
    differ = df.where(F.col(a) != F.col(b)).select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b"))
    return rewritten(differ, ["__a", "__b"], frequency).where("__a = __b").select(*keys)

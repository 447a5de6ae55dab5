"""Column functions on text: normal forms, letters of syllables, similarity, cleaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letters of a syllable block in their code order.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition; only texts with conjoining letters or marks pass through Python."""
    decomposed = c.rlike(r"[\x{0300}-\x{036F}\x{1100}-\x{11FF}\x{3099}\x{309A}\x{212A}\x{212B}\x{2126}\x{F900}-\x{FAFF}]")
    return F.coalesce(_nfc(F.when(decomposed, c)), c)


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def n1(c: Column) -> Column:
    """Composed, East Asian punctuation made plain, white space squeezed."""
    return squeeze(F.translate(nfc(c), "。，？！·", ".,?! "))


# The marks that each normal form takes for punctuation, its glosses, and what the last one evens out.
MARKS_OF_WORDS = r"[.,!?;:\"'()\[\]{}…·\-–—]"
MARKS_OF_N4 = r"[.,!?;:()\\\[\]{}\"']+"
MARKS_OF_N5 = r"[.,!?;:()\[\]{}\"'`~@#$%^&*+=<>/\\|_\-]"
GLOSS_OF_N4 = r"[A-Za-z\-]+\(([가-힣\s]+)\)"
GLOSS_OF_N5 = r"[A-Za-z]+\(([가-힣]+)\)"
LATIN_IN_BRACKETS = r"\([A-Za-z\s]+\)"
SOUNDS_OF_N6 = ["음", "어", "아", "그", "네", "예", "에"]
ENDINGS_OF_N6 = [("하세요|하십시오|합니다|해요|합니까", "해"), ("입니다|이에요|예요", "야"), ("습니다|읍니다", ""), ("거든요|거든", "거든"), ("잖아요|잖아", "잖아")]

#: What a word is made of, where the end of one matters.
LETTER = r"[\p{L}\p{N}_]"


def n2_words(c: Column) -> Column:
    """Words once punctuation is space."""
    return F.filter(F.split(squeeze(F.regexp_replace(c, MARKS_OF_WORDS, " ")), " "), lambda w: w != "")


def n3(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, r"\s", "")


def n4(c: Column) -> Column:
    """Composed, loan words by their Korean spelling, punctuation dropped, lower case."""
    t = F.regexp_replace(F.trim(nfc(c)), GLOSS_OF_N4, "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), MARKS_OF_N4, ""))


def n5(c: Column) -> Column:
    """As n4, with Latin glosses, more punctuation and white space dropped."""
    return F.lower(F.regexp_replace(_marks_dropped(c), r"\s+", ""))


def _marks_dropped(c: Column) -> Column:
    t = F.regexp_replace(nfc(c), GLOSS_OF_N5, "$1")
    return F.regexp_replace(F.regexp_replace(t, LATIN_IN_BRACKETS, ""), MARKS_OF_N5, "")


def n6(c: Column, sounds: list[str] = SOUNDS_OF_N6, endings: list[tuple[str, str]] = ENDINGS_OF_N6) -> Column:
    """As n5, with lone sounds dropped, polite endings evened out and the last 요 of words dropped."""
    t = _marks_dropped(c)
    for x in sounds:
        t = F.regexp_replace(t, f"(?<!{LETTER}){x}(?!{LETTER})", "")
    for pattern, to in endings:
        t = F.regexp_replace(t, pattern, to)
    return F.lower(F.regexp_replace(F.regexp_replace(t, f"요(?!{LETTER})", ""), r"\s+", ""))


def coalesced(*columns: Column) -> Column:
    """The first text that isn't null or blank, trimmed; empty if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def n7(c: Column) -> Column:
    """Composed letters and numbers of any script and underscores only, lower case."""
    return F.lower(F.regexp_replace(nfc(c), r"[^\p{L}\p{N}_]", ""))


def n8(c: Column) -> Column:
    """Composed, without spaces, newlines and tabs."""
    return F.translate(nfc(c), " \n\t", "")


def jamo(c: Column) -> Column:
    """Syllables as the letters they are made of; other characters stay."""

    def one(ch: Column) -> Column:
        k = F.ascii(ch) - 0xAC00
        lead = F.substring(F.lit(LEADS), F.floor(k / 588).cast("int") + 1, F.lit(1))
        vowel = F.substring(F.lit(VOWELS), F.floor((k % 588) / 28).cast("int") + 1, F.lit(1))
        tail = F.when(k % 28 > 0, F.substring(F.lit(TAILS), (k % 28).cast("int") + 1, F.lit(1))).otherwise("")
        return F.when((k >= 0) & (k <= 11171), F.concat(lead, vowel, tail)).otherwise(ch)

    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), "")


def is_hangul(c: Column) -> Column:
    """Whether the first character is a whole syllable."""
    return F.ascii(c).between(0xAC00, 0xD7A3)


def jamo_similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over letters by the longer length; 1 for two empty texts."""
    x, y = jamo(a), jamo(b)
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / n)


def char_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct characters, spaces aside; 0 if either is empty."""
    cs = lambda t: F.array_distinct(F.filter(F.split(F.regexp_replace(t, r"\s", ""), ""), lambda x: x != ""))
    x, y = cs(a), cs(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def sound_marks_removed(c: Column, marks: list[str]) -> Column:
    """Bracketed sound marks and music signs removed."""
    words = "|".join(marks)
    return squeeze(F.regexp_replace(F.regexp_replace(c, rf"[\[(<{{*【]\s*(?:{words})\s*[\])>}}*】]", " "), r"[♩♪♫♬]+", " "))


def valid_segment(c: Column, least: int = 2) -> Column:
    """Not empty, long enough, not punctuation only and not a lone filler mark."""
    t = F.trim(c)
    return F.coalesce((F.length(t) >= least) & ~t.rlike(r"^[\s.,!?~…·\-]+$") & ~t.rlike(r"^(\[filler\]\s*)+$"), F.lit(False))


def sino_number(c: Column) -> Column:
    """A Sino-Korean numeral as a number, evaluated inside the JVM; null for an unknown sign, for zero and for nothing."""
    digit = F.create_map(*[x for k, v in zip("영일이삼사오육칠팔구", range(10)) for x in (F.lit(k), F.lit(v))])
    unit = F.create_map(F.lit("십"), F.lit(10), F.lit("백"), F.lit(100), F.lit("천"), F.lit(1000), F.lit("만"), F.lit(10000))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("held"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        d, u = digit[ch], unit[ch]
        held = F.when(acc["held"] == 0, F.lit(1).cast("bigint")).otherwise(acc["held"])
        ten_thousands = acc["total"] + F.when((acc["held"] == 0) & (acc["total"] > 0), F.lit(0).cast("bigint")).otherwise(held)
        total = F.when(u == 10000, ten_thousands * 10000).when(u.isNotNull(), acc["total"] + held * u).otherwise(acc["total"])
        return F.struct(total.cast("bigint").alias("total"), F.coalesce(d, F.lit(0)).cast("bigint").alias("held"), (acc["ok"] & (d.isNotNull() | u.isNotNull())).alias("ok"))

    done = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step)
    value = done["total"] + done["held"]
    return F.when(done["ok"] & (value > 0), value)


def without_particle(c: Column, particles: list[str]) -> Column:
    """The word without the first listed particle that ends it and leaves more than one character."""
    out = F.when(F.lit(False), c)
    for p in particles:
        out = out.when(c.endswith(p) & (F.length(c) > len(p) + 1), F.expr(f"'{p}'"))
    return F.coalesce(F.substring(c, F.lit(1), F.length(c) - F.length(out)), c)

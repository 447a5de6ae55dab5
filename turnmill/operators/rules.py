"""Ordered rewrite rules with context hints, applied as one fold per text inside the JVM."""

from __future__ import annotations

import re

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.cleaning import engine_cleaned
from turnmill.functions.text import LEADS, TAILS, VOWELS

#: A rule table is a dimension; beyond this many enabled rules it is refused rather than shipped with the plan.
MOST_RULES = 20_000
REACH = 30


def ordered_rules(rules: DataFrame, strategies: list[str]) -> list[dict]:
    """Enabled rules of the strategies by priority, length of ``wrong`` (both descending) and id; a rule without an id goes by its word."""
    rows = rules.where(F.col("enabled") & F.col("strategy").isin(strategies) & F.col("wrong").isNotNull() & (F.col("wrong") != "") & F.col("correct").isNotNull())
    hints = F.array_compact(F.coalesce("context_hint", F.array().cast("array<string>"))).alias("hints")
    found = rows.select(F.coalesce(F.col("id").cast("string"), "wrong").alias("id"), "wrong", "correct", "strategy", "pattern", hints, F.coalesce("priority", F.lit(50)).alias("priority"), "confidence").take(MOST_RULES + 1)
    if len(found) > MOST_RULES:
        raise ValueError("too many rules for a fold")
    return sorted((r.asDict() for r in found), key=lambda r: (-r["priority"], -len(r["wrong"]), r["id"]))


def _hinted(text: Column, wrong: Column, hints: Column, reach: int | None) -> Column:
    """No hints, or one of them near the first occurrence (anywhere if ``reach`` is None)."""
    at = F.instr(text, wrong) - 1
    near = F.lower(text) if reach is None else F.lower(F.substring(text, F.greatest(at - reach, F.lit(0)) + 1, F.least(at + reach, F.length(text)) - F.greatest(at - reach, F.lit(0))))
    return (F.size(hints) == 0) | F.exists(hints, lambda h: F.contains(near, F.lower(h)))


def valid_pattern(pattern: str | None) -> bool:
    try:
        return bool(pattern) and bool(re.compile(pattern) or True)
    except re.error:
        return False


@lru_cache(1 << 16)
def letters(s: str) -> str:
    """Syllables as the letters they are made of."""
    out = []
    for c in s:
        k = ord(c) - 0xAC00
        out.append(LEADS[k // 588] + VOWELS[k % 588 // 28] + TAILS[k % 28].strip() if 0 <= k < 11172 else c)
    return "".join(out)


@lru_cache(1 << 18)
def likeness(a: str, b: str) -> float:
    """One minus the edit distance of two strings of letters by the longer length; 1 for two empty ones."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return 1 - row[-1] / (max(len(a), len(b)) or 1)


@lru_cache(1 << 18)
def _may_be_like(a: str, b: str, least: float) -> bool:
    """Whether the letters that both hold leave room for the likeness: each letter that one lacks costs an edit."""
    n = max(len(a), len(b)) or 1
    shared = sum(min(a.count(c), b.count(c)) for c in set(b))
    return 1 - (n - shared) / n >= least


def _near(text: str, at: int, hints: list[str], reach: int | None) -> bool:
    """No hints, or one of them within ``reach`` characters of the place (anywhere if None), whatever their case."""
    around = (text if reach is None else text[max(0, at - reach) : at + reach]).lower()
    return not hints or any(h.lower() in around for h in hints)


class Corrector:
    """Rules of one table applied to a text, in order: cleaning, patterns, exact words, words that sound alike.

    ``strategies`` says which kinds of rules run, ``clean`` whether repeats are dropped first. Exact rules go by
    priority and length, the others by id; a rule sees what the rules before it made. Which exact rules can apply is
    told by one pass over the text for all words, repeated where a rule changed it.
    """

    def __init__(self, rules: list[dict], strategies: tuple[str, ...] = ("regex", "exact", "phonetic"), clean: bool = True, reach: int | None = REACH):
        by = lambda s: sorted((r for r in rules if r["strategy"] == s), key=lambda r: r["id"]) if s in strategies else []
        self.clean, self.reach = clean, reach
        self.regex = [(r, re.compile(r["pattern"])) for r in by("regex") if valid_pattern(r["pattern"])]
        self.exact = [r for r in rules if r["strategy"] == "exact"] if "exact" in strategies else []
        self.phonetic = [(r, [h.lower() for h in r["hints"]], letters(r["wrong"])) for r in by("phonetic") if r["hints"] and r["wrong"]]
        self.words: dict[str, list[int]] = {}
        for i, r in enumerate(self.exact):
            self.words.setdefault(r["wrong"], []).append(i)
        self.automaton = self._built(list(self.words))

    @staticmethod
    def _built(words: list[str]):
        try:
            import ahocorasick
        except ImportError:
            return None
        a = ahocorasick.Automaton()
        for w in words:
            a.add_word(w, w)
        if words:
            a.make_automaton()
        return a

    def _present(self, text: str, after: int) -> list[int]:
        """Exact rules behind the given one whose word is in the text, in order."""
        if not self.words:
            return []
        found = {w for w in self.words if w in text} if self.automaton is None else {w for _, w in self.automaton.iter(text)}
        return sorted(i for w in found for i in self.words[w] if i > after)

    def __call__(self, text: str) -> tuple[str, list[tuple[str, str, str, str]]]:
        """The text and (original, corrected, rule, tier) of every change."""
        log: list[tuple[str, str, str, str]] = []
        if not text or not text.strip():
            return text, log
        if self.clean:
            cleaned = engine_cleaned(text)
            if cleaned != text:
                log.append((text, cleaned, "hallucination_filter", "hallucination"))
                text = cleaned
        for r, pattern in self.regex:
            new = pattern.sub(r["correct"], text)
            if new != text:
                log.append((text, new, r["id"], "tier1_dict"))
                text = new
        waiting = self._present(text, -1)
        while waiting:
            i = waiting.pop(0)
            r = self.exact[i]
            if _near(text, text.find(r["wrong"]), r["hints"], self.reach):
                new = text.replace(r["wrong"], r["correct"])
                if new != text:
                    log.append((r["wrong"], r["correct"], r["id"], "tier1_dict"))
                    text = new
                    waiting = self._present(text, i)
        low = text.lower()
        for r, hints, goal in self.phonetic:
            for h in hints:
                if h in low:
                    text = self._sounding(text, r, goal, log)
                    low = text.lower()
                    break
        return text, log

    def _sounding(self, text: str, r: dict, goal: str, log: list) -> str:
        n, least = len(r["wrong"]), r["confidence"] if r["confidence"] is not None else 1.0
        i = 0
        while i <= len(text) - n:
            w = text[i : i + n]
            if _may_be_like(letters(w), goal, least) and w != r["correct"] and likeness(letters(w), goal) >= least and _near(text, i, r["hints"], self.reach):
                log.append((w, r["correct"], r["id"], "tier1_dict"))
                text = text[:i] + r["correct"] + text[i + n :]
                i += len(r["correct"])
            else:
                i += 1
        return text


CHANGES = "array<struct<original: string, corrected: string, rule: string, tier: string>>"


def corrected(text: Column, corrector: Corrector) -> Column:
    """struct(text, logs): Arrow-batched; null stays null."""

    @F.pandas_udf(f"text string, logs {CHANGES}")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if t is None else corrector(t) for t in texts]
        names = ("original", "corrected", "rule", "tier")
        return pd.DataFrame({"text": [t for t, _ in rows], "logs": [[dict(zip(names, x)) for x in log] for _, log in rows]})

    # so declared, its result stays a column of its own and isn't put into later lambdas
    return run.asNondeterministic()(text)


def exact(text: Column, rules: list[dict], reach: int | None = REACH) -> Column:
    """struct(text, applied): exact rules only; ids of applied rules in order."""
    x = corrected(text, Corrector([r | {"strategy": "exact"} for r in rules], ("exact",), clean=False, reach=reach))
    return F.struct(x["text"].alias("text"), F.transform(x["logs"], lambda l: l["rule"]).alias("applied"))


def patterns(text: Column, rules: list[dict]) -> Column:
    """Regex rules in the order of the list; rules whose pattern doesn't compile are left out; ``\\1`` in a replacement becomes a group."""
    for r in rules:
        if valid_pattern(r["pattern"]):
            to = re.sub(r"\\(\d)", r"$\1", r["correct"].replace("$", r"\$"))
            text = F.regexp_replace(text, r["pattern"], to)
    return text


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct(text, applied): plain replacements in order, and how many of them found something; for want of a rule table."""
    start = F.struct(text.alias("text"), F.lit(0).alias("applied"))
    if not pairs:
        return start
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])

    def step(acc: Column, r: Column) -> Column:
        return F.struct(F.replace(acc["text"], r["a"], r["b"]).alias("text"), (acc["applied"] + F.contains(acc["text"], r["a"]).cast("int")).alias("applied"))

    return F.aggregate(table, start, step)


def safely(f: Callable[[str], str]) -> Callable[[str], str]:
    """The function, giving back its argument where it fails."""

    def run(text: str) -> str:
        try:
            return f(text)
        except Exception:  # noqa: BLE001 - any failure of a rule leaves the text as it was
            return text

    return run


def matches(texts: DataFrame, rules: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, rules): how many rules have their word in the text with a hint (if any) anywhere in it.

    Words of rules and texts meet on the pieces that both hold, so a table of any size is no literal of the plan: a
    word's first two characters are its piece, looked up among the neighbouring pairs of each text.
    """
    r = rules.where("enabled and wrong is not null and wrong <> ''").select("wrong", F.coalesce("context_hint", F.array().cast("array<string>")).alias("hints"), F.left("wrong", F.lit(2)).alias("piece"))
    t = texts.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("__t"))
    n = F.length("__t")
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring("__t", i, F.lit(k)))
    pieces = F.array_distinct(F.concat(at(1), at(2)))
    hit = F.contains("__t", F.col("wrong")) & ((F.size("hints") == 0) | F.exists("hints", lambda h: F.contains(F.lower("__t"), F.lower(h))))
    met = t.withColumn("piece", F.explode(pieces)).join(r, "piece").where(hit).groupBy(*key).agg(F.count("*").alias("rules"))
    return t.select(*key).join(met, key, "left").select(*key, F.coalesce("rules", F.lit(0)).alias("rules"))


def upserted(rules: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rules with partial updates: a null in ``changes`` keeps the old value; new keys are added."""
    old, new = rules.alias("o"), changes.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns else F.col(f"o.{c}").alias(c) for c in rules.columns]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def deleted(rules: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rules.join(keys.select(key), key, "left_anti")


def learnable(candidates: DataFrame, rules: DataFrame, safe: list[str] = (), particles: list[str] = ()) -> DataFrame:
    """Candidate (wrong, correct) pairs that may become rules, with their priority.

    Left out are equal ones, safe words, those that differ by particles only, those of which one holds the other and is
    at most two characters longer, and words that have a rule. Priority is 50 and the length.
    """
    from turnmill.functions.cleaning import only_particle_differs

    c = candidates.where("wrong is not null and correct is not null and wrong <> correct")
    c = c.groupBy("wrong").agg(F.min("correct").alias("correct"))
    inside = (F.contains("correct", F.col("wrong")) | F.contains("wrong", F.col("correct"))) & (F.abs(F.length("wrong") - F.length("correct")) <= 2)
    if safe:
        c = c.where(~F.col("wrong").isin(list(safe)))
    if particles:
        c = c.where(~only_particle_differs(F.col("wrong"), F.col("correct"), list(particles)))
    return c.where(~inside).join(rules.where("wrong is not null").select("wrong").distinct(), "wrong", "left_anti").withColumn("priority", 50 + F.length("wrong"))

"""Problem 2: texts cut off by a limit or in transfer.

Values that end by themselves are cut artificially - anywhere, and at the limits
that the lengths of their source betray - with or without what a cut leaves
behind (a replacement character, dots, half an escape, half a syllable). A
logistic regression over hashed features of the closing characters and words,
the punctuation, the counted against the stored length, the length against the
source's limits and the reference's continuation is trained to tell the cut
heads from stored values; then every row is scored.

Stored values hold cut ones themselves. Rows with plain evidence (a count above
the stored length, a broken remnant) are therefore no negatives, and after a
first fit neither are those that look cut; nor are values without a full stop
whose length is a limit of their source. Negatives are also shown without
their full stop. An artificial cut behind a whole sentence is used where the
source counts before it stores, as the count betrays it; elsewhere nothing tells
such a cut from a text that ends there, and it is left out. The evidence is
features of the classifier like all else; its probability alone decides.

Texts are read twice: once to write what is counted (lengths, habits of a source
and the rows of the sample, the latter with their texts), once to score.

The classifier is fitted on at most ``SAMPLE_ROWS`` rows, chosen by a hash of
the key; limits, counting habits and scores are computed over all rows. A null
or blank text is no case: nothing is left to be the head of another text.
"""

from __future__ import annotations

import unicodedata as ud
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut_lineage

#: Bound of the rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000
#: Hashed features, and how many a row can have.
DIMENSIONS = 1 << 18
MOST = 32
STEPS = 150
RIDGE = 2e-5
#: A row is cut from this probability on; a stored value from the second on is no sure negative.
CUT = 0.5
DOUBT = 0.35
#: Shorter lengths that pile up are short answers, no limits.
SHORTEST_LIMIT = 20

_STOP = regex.compile(r"[.?!。]['\"”’)\]]*\s*$")
#: What a cut can leave: half an escape, a lone letter of a syllable, a replacement character.
_BROKEN = regex.compile(r"(?:&(?:#?[0-9A-Za-z]{0,7})?|\\u?[0-9A-Fa-f]{0,3}|(?:=[0-9A-F]{2})*=[0-9A-F]?(?:=[0-9A-F]{2})*|(?:=[0-9A-F]{2})+|(?:%[0-9A-F]{2})*%[0-9A-F]?|[ㄱ-ㅎ]|�)$")
_DOTS = regex.compile(r"\s*(?:\.{2,}|…)$")
_DIGITS = regex.compile(r"\d+")
_WEEKDAY = regex.compile(r"[월화수목금토일]요일")
_SPLIT = regex.compile(r"(?<=[.?!])\s+")


def _normal(t: str) -> str:
    if t.isascii():
        return t
    return "".join(c for c in ud.normalize("NFKC", t.replace("…", "")) if ud.category(c) != "Cf").replace("", "…")


def counted(t: str) -> int:
    """Characters of the composed text without spaces, newlines and tabs."""
    return len(ud.normalize("NFC", t).translate({32: None, 10: None, 9: None}))


def broken(t: str) -> bool:
    """Whether the text ends in the remnant of a character or escape."""
    return bool(_BROKEN.search(t.rstrip()))


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % (DIMENSIONS - 2) + 2


def features(text: str, reference: str | None, hyp_len: float | None, source: str | None, before: bool, at_limit: bool) -> list[int]:
    """Hashed features of one row; 0 is the padding and 1 the bias."""
    t = _normal(text)
    body = t.rstrip()
    left = "none"
    if m := _BROKEN.search(body):
        left, body = "broken", body[: m.start()]
    elif m := _DOTS.search(body):
        left, body = "dots", body[: m.start()]
    core = _WEEKDAY.sub("요일", _DIGITS.sub("0", body.rstrip()))
    stop = bool(_STOP.search(core)) and left == "none"
    words = core.split()[-24:]
    last = _SPLIT.split(core)[-1].split()
    f = [f"stop:{stop}", f"left:{left}", f"left:{left}:{source}", f"tail:{t[-1:].isspace()}:{stop}"]
    f += [f"c{k}:{core[-k:]}" for k in (1, 2, 3, 4, 6)]
    f += [f"w{k}:{' '.join(words[-k:])}" for k in (1, 2, 3, 4)]
    if last:
        f += [f"s:{' '.join(last[:2])}|{last[-1]}", f"h:{last[0]}|{last[-1]}", f"n:{min(len(last), 9)}:{stop}", f"x:{' '.join(last[:1])}|{min(len(last), 9)}|{stop}"]
    there = counted(text)
    if hyp_len is None or hyp_len != hyp_len:
        f.append("count:none")
    else:
        told = "over" if hyp_len > there else "same" if hyp_len == there else "under"
        f += [f"count:{told}", f"count:{told}:{before}", f"count:{told}:{stop}"]
    f += [f"limit:{at_limit}:{stop}", f"limit:{at_limit}:{left}"]
    if reference:
        r = _WEEKDAY.sub("요일", _DIGITS.sub("0", _normal(reference)))
        end = core[-10:]
        at = r.rfind(end) if len(end) >= 5 else -1
        rest = r[at + len(end) :] if at >= 0 else ""
        kind = "apart" if at < 0 else "end" if not rest.strip(" .?!…") else "word" if rest[0].isalnum() else "more"
        f.append(f"ref:{kind}:{stop}")
    return [1, *map(_hash, f)][:MOST]


#: What artificial cuts leave behind, with weights.
_LEFT = [("", 10), ("�", 1), ("…", 1), ("...", 1), ("jamo", 2), ("&am", 1), ("&#x", 1), ("\\u00", 1), ("=EC=9", 1)]


def artificial(text: str, limits: list[int], rng: np.random.Generator, betrayed: bool = False) -> str | None:
    """A cut head of the text, or None if it would end like a whole one and no count betrays it."""
    fitting = [n for n in limits if 2 <= n < len(text)]
    n = int(rng.choice(fitting)) if fitting and rng.random() < 0.5 else int(rng.integers(2, max(3, len(text))))
    head = text[:n]
    if (_STOP.search(_normal(head)) and not betrayed) or not head.strip() or not text[n:].strip(" .?!．？"):
        return None
    weights = np.array([w for _, w in _LEFT], float)
    left = _LEFT[int(rng.choice(len(_LEFT), p=weights / weights.sum()))][0]
    if left == "jamo":
        c = text[n]
        left = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"[(ord(c) - 0xAC00) // 588] if "가" <= c <= "힣" else ""
    return head + left


def _matrix(rows: list[list[int]]) -> np.ndarray:
    m = np.zeros((len(rows), MOST), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Adam over the whole sample; column 0 is padding and stays 0, column 1 is the bias.

    Only the columns that occur in the sample are carried: all others would stay 0.
    """
    used, flat = np.unique(x.ravel(), return_inverse=True)
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    dense, many = flat.reshape(x.shape), x.shape[1]
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        g = weight * (probabilities(w, dense) - y)
        grad = np.bincount(flat, np.repeat(g, many), len(used)) + RIDGE * w
        grad[used == 0] = 0.0
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    out = np.zeros(DIMENSIONS)
    out[used] = w
    return out


def probabilities(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-w[x].sum(1)))


def train(sample: pd.DataFrame, limits: dict[str, list[int]], seed: int = 7) -> np.ndarray:
    """Weights from rows (text, reference, hyp_len, source, before, at_limit)."""
    rng = np.random.default_rng(seed)
    rows, label, plain, fold = [], [], [], []
    for i, r in enumerate(sample.itertuples(index=False)):
        fold += [(i - 1) % 2] * (len(rows) - len(fold))
        t, there = r.text, counted(r.text)
        known = r.hyp_len is not None and r.hyp_len == r.hyp_len
        ends = bool(_STOP.search(_normal(t))) and not _DOTS.search(_normal(t))
        if not (known and r.hyp_len > there) and not broken(_normal(t)) and (ends or not r.at_limit):
            rows.append(features(t, r.reference, r.hyp_len, r.source, r.before, r.at_limit))
            label.append(0)
            plain.append(False)
        if not ends:
            continue
        bare = t.rstrip().rstrip(".．")
        if bare != t and bare:
            n = counted(bare) if known else None
            rows.append(features(bare, r.reference, n, r.source, r.before, False))
            label.append(0)
            plain.append(True)
        for _ in range(2):
            over = bool(known and (r.before or rng.random() < 0.25))  # the count was taken before the cut
            head = artificial(t, limits.get(r.source, []), rng, over)
            if head is None:
                continue
            n = None if not known else there if over else counted(head)
            core = len(head)
            at = any(abs(core - k) <= 3 for k in limits.get(r.source, []))
            rows.append(features(head, r.reference, n, r.source, r.before, at))
            label.append(1)
            plain.append(True)
    if not rows or not any(label):
        return np.zeros(DIMENSIONS)
    fold += [len(sample) % 2] * (len(rows) - len(fold))
    x, y, sure, fold = _matrix(rows), np.array(label, float), np.array(plain), np.array(fold)
    weight = np.where(y > 0, 0.5, 1.0)
    keep = sure.copy()
    # a stored value is a negative only if a model that never saw it doesn't take it for cut
    for k in (0, 1):
        seen, other = fold == k, fold != k
        if seen.any() and other.any():
            keep[other] |= probabilities(_fit(x[seen], y[seen], weight[seen]), x[other]) < DOUBT
    return _fit(x[keep], y[keep], weight[keep])


def _habits(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of (source, chars, bytes, over): whether a source counts before it stores, and the lengths that are its limits."""
    habit = rows.groupBy(F.col("source").alias("of")).agg((F.coalesce(F.avg("over"), F.lit(0.0)) > 0.002).alias("before"))
    marks = []
    for length in ("chars", "bytes"):
        by = rows.groupBy("source", length).agg(F.count("*").alias("n"))
        near = Window.partitionBy("source").orderBy(length).rangeBetween(-10, 10)
        usual = (F.sum("n").over(near) - F.col("n")) / 20
        by = by.where(F.col(length).isNotNull()).withColumn("usual", usual)
        marks.append(by.where((F.col(length) >= SHORTEST_LIMIT) & (F.col("n") >= 6) & (F.col("n") >= 4 * F.col("usual"))).select("source", length, F.lit(True).alias(f"at_{length}")))
    return habit, marks


def _told(rows: DataFrame, habit: DataFrame, marks: list[DataFrame], key: list[str]) -> DataFrame:
    """Adds what the source's habit and limits say about each row."""
    out = rows.join(habit, F.col("source").eqNullSafe(F.col("of")), "left")
    for length, mark in zip(("chars", "bytes"), marks):
        out = out.join(mark, ["source", length], "left")
    at = F.coalesce("at_chars", F.lit(False))
    return out.select(*key, "source", "text", "reference", "hyp_len", "chars", F.coalesce("before", F.lit(False)).alias("before"), (at | F.coalesce("at_bytes", F.lit(False))).alias("at_limit"), at.alias("at_chars"))


def scored(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, source, probability, cut) of every row of (key, source, text, reference, hyp_len)."""
    rows = rows.select(*key, "source", "text", "reference", F.col("hyp_len").cast("double").alias("hyp_len"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    part = int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, rows.count())))
    picked = (F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < part) & (F.trim("text") != "")
    # composed letters count once, so only texts without decomposed ones tell how the source counts
    squeezed = F.length(F.translate("text", " \n\t", ""))
    kept = [F.when(picked, F.col(c)).alias(c) for c in ("text", "reference")]
    slim = cut_lineage(rows.select(*key, "source", *kept, "hyp_len", "chars", "bytes", (F.col("hyp_len") > squeezed).cast("int").alias("over")))
    habit, marks = (cut_lineage(h) if isinstance(h, DataFrame) else [cut_lineage(m) for m in h] for h in _habits(slim.select("source", "chars", "bytes", "over")))
    sample = _told(slim.where("text is not null"), habit, marks, key).orderBy(*key).toPandas()
    limits = {s: sorted(g["chars"].unique().tolist()) for s, g in sample[sample["at_chars"]].groupby("source")}
    shared = rows.sparkSession.sparkContext.broadcast(train(sample, limits).astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(float)
        for b in batches:
            d = b.to_pydict()
            has = np.array([bool(t and t.strip()) for t in d["text"]], bool)
            x = _matrix(
                [
                    features(t, r, h, s, bf, at) if there else [0]
                    for there, t, r, h, s, bf, at in zip(has, d["text"], d["reference"], d["hyp_len"], d["source"], d["before"], d["at_limit"])
                ]
            )
            p = np.where(has, probabilities(weights, x), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), b.column("source"), pa.array(p), pa.array(p >= CUT)], [*key, "source", "probability", "cut"])

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    return _told(rows, habit, marks, key).mapInArrow(score, f"{types}, source string, probability double, cut boolean")

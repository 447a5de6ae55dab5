"""Problem 1: raw transcript segments into clean speaker turns.

Each segment is a node of its file's precedence graph. *Timing* edges run along
the nodes that have a ``start``, in the order of (start, seq); *cue* edges put a
node without ``start`` among them by the mark of time written in its text;
*dialogue* edges run from each arrival to the next one. Timing and cue edges
form one chain. A dialogue edge that contradicts it would close a cycle and is
dropped as the weaker one; the others place the nodes that carry no time at all:
behind their predecessor in arrival or, with none, before their successor.
Kahn's algorithm then orders what is left and hands each node the greatest time
on the way to it, so (time, seq) is a topological order that blocks share.
Spans of time marks, noises, labels and hesitation are removed, and runs of one
role are merged.

Everything is keyed by (file, block): graphs of ``SEQ_BLOCK`` arrivals whose
dialogue edges reach into the blocks before and after through one summary row a
block, and then turns in blocks of ``TIME_BLOCK`` seconds, so a file holding a
third of all rows is spread over many tasks.

Defined cases: a null or blank text, or one without speech, doesn't count. NaN
bounds are missing. Re-delivered segments (same file and seq) are taken once,
the least of copies that differ. Rows without a file or seq name no segment and
are left out. Counting segments before the first known role of a file are one
turn of unknown role (null). A file without any time is in order of arrival.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import blocked
from turnmill.session import cut_lineage

SEQ_BLOCK = 1024
TIME_BLOCK = 900.0

# The words that name a role, and the sounds and noises that aren't speech.
ROLE_WORDS = {
    "doctor": ["의사", "의사선생님", "의사 선생님", "원장", "원장님", "원장선생님", "원장 선생님", "닥터", "doctor", "dr", "physician"],
    "patient": ["환자", "환자분", "환자님", "patient", "pt"],
    "guardian": ["보호자", "보호자분", "보호자님", "guardian", "caregiver"],
    "nurse": ["간호사", "간호사님", "간호사선생님", "간호사 선생님", "nurse", "rn"],
}
NOISE_WORDS = ["한숨", "침묵", "전화벨", "웃음", "기침", "기침 소리", "음악", "박수", "잡음", "문 닫는 소리", "noise", "inaudible", "filler", "music", "laughter", "applause", "silence"]
HESITATION = ["[어음으흠]+", "아+", "에+", "그", "저", "[Uu]+[hm]+", "[Hh]m+", "[Ee]r+m*"]

_TIME = r"\d+:\d{1,2}(?::\d{1,2})?(?:[.,]\d+)?"
_CLOCK = r"\d+:\d{1,2}:\d{1,2}(?:[.,]\d+)?"
_SPELLED = r"(?:\d+\s*시간\s*)?(?:\d+\s*분\s*)?\d+(?:\.\d+)?\s*(?:초|s|sec)"
#: Marks of time: bracketed clock times and spelled durations anywhere, bare clock times of three parts.
TIME_MARK = rf"[\[(<{{【]\s*(?:{_TIME}|{_SPELLED})\s*[\])>}}】]|(?<![\d:]){_CLOCK}(?![\d:])(?:\s*-->(?:\s*{_CLOCK})?)?"
_NOISES = "|".join(NOISE_WORDS)
NOISE_MARK = rf"[♩♪♫♬\x{{1F3B5}}\x{{1F3B6}}]+|\(\(\s*(?:{_NOISES})\s*\)\)|[\[(<{{【*]\s*(?:{_NOISES})\s*[\])>}}】*]"
#: Any other bracketed words; "(at)" and "[dot]" disguise addresses and stay.
OTHER_MARK = r"\(\((?!\s*(?:at|dot)\s*\))[\p{L} ]{1,20}\)\)|[\[<{【](?!\s*(?:at|dot)\s*[\]>}】])[\p{L} ]{1,20}[\]>}】]|\((?!\s*(?:at|dot)\s*\))[\p{L} ]{1,20}\)|\*[\p{L} ]{1,20}\*"
_LABELS = "|".join(w.replace(" ", r"\s*") for ws in ROLE_WORDS.values() for w in sorted(ws, key=len, reverse=True))
_LABEL = rf"((?i:{_LABELS})\.?|(?i:speaker|spk|s|화자)[\s_-]*\d{{1,3}})"
LABEL = rf"^[\s\p{{Z}}\p{{Cf}}]*(?:[\[(<【]\s*{_LABEL}\s*[\])>】]\s*[:：]?|{_LABEL}\s*[:：>)\]]|{_LABEL}\s+[-–—](?=\s|$))\s*"
_SOUND = "(?:" + "|".join(HESITATION) + ")"
#: Hesitation inside speech needs a mark that it trails off; "그" and "저" are words without one.
FILLER = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(h for h in HESITATION if h not in ('그', '저'))})(?:\s*(?:\.{{2,}}|…)[.…]*\s*,?|\s*,)|(?:그|저)(?:\.{{2,}}|…)[.…]*,?)(?=\s|$)"
#: A sound of hesitation on its own, and what shows that something else is said. Removing the one and looking for the
#: other is a loop, where one pattern for the whole text would recurse with its length.
LONE_SOUND = rf"(?<![\p{{L}}\p{{N}}]){_SOUND}(?![\p{{L}}\p{{N}}])"
SPOKEN = r"[^\s\p{Z}\p{P}\p{Cf}]"

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = "".join(map(chr, range(0x21, 0x7F)))


def _role_word(c: Column) -> Column:
    """The role that a normalised label names, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, words in ROLE_WORDS.items():
        out = out.when(c.isin([w.replace(" ", "") for w in words]), role)
    return out


def _tidy_label(c: Column) -> Column:
    """Lower case, half width, without brackets, punctuation, spaces and invisible characters."""
    return F.regexp_replace(F.lower(F.translate(c, _FULL, _HALF)), r"[\s\p{Z}\p{Cf}\p{P}]+", "")


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:speaker|spk|s|화자)0*(\d{1,6})$", 1).try_cast("int")


#: Characters without which a pattern can't match; looking for one of them costs a tenth of trying the pattern.
MARK_SIGNS = r"[:\[(<{【*♩♪♫♬\x{1F3B5}\x{1F3B6}]"
LABEL_SIGNS = r"[:：>)\]】\-–—]"
FILLER_SIGNS = r"\.\.|[…,]"
BRACKETS = r"[\[<{【(*]"
#: A character of speech that no sound of hesitation holds.
SURELY_SPOKEN = r"[^\s\p{Z}\p{P}\p{Cf}어음으흠아에그저UuHhMmEeRr]"


def _replaced(c: Column, signs: str, *patterns: str) -> Column:
    """The patterns replaced by spaces; texts without any of the signs they need are left alone."""
    out = c
    for p in patterns:
        out = F.regexp_replace(out, p, " ")
    return F.when(c.rlike(signs), out).otherwise(c)


def cleaned(df: DataFrame, role_codes: DataFrame, words: bool = True) -> DataFrame:
    """(file_id, seq, start, cue, role, spoken[, speech]): each row's role, whether anything is said and, with ``words``, what.

    The role is that of ``speaker``, else that of a label at the head of ``text``, else null. The cue is read only
    where ``start`` is missing.
    """
    start = F.when(~F.isnan("start"), F.col("start").cast("double"))
    text = F.coalesce("text", F.lit(""))
    mark = F.regexp_extract(text, rf"^\s*(?:[\[(<【]\s*)?({_TIME})", 1)
    t1 = df.where("file_id is not null and seq is not null").select(
        F.col("file_id").cast("string").alias("file_id"),
        F.col("seq").cast("bigint").alias("seq"),
        start.alias("start"),
        F.when(start.isNull() & F.contains(text, F.lit(":")), mark).otherwise("").alias("mark"),
        _replaced(text, MARK_SIGNS, TIME_MARK, NOISE_MARK).alias("t"),
        _tidy_label(F.coalesce("speaker", F.lit(""))).alias("who"),
    )
    t2 = t1.withColumn("head", F.when(F.col("t").rlike(LABEL_SIGNS), F.regexp_extract("t", LABEL, 0)).otherwise(""))
    t2 = t2.withColumn("t", F.when(F.col("head") != "", F.concat(F.lit(" "), F.substring("t", F.length("head") + 1, F.length("t")))).otherwise(F.col("t")))
    t2 = t2.withColumn("label", F.translate(_tidy_label(F.col("head")), "<>", "")).withColumn("t", _replaced(F.col("t"), BRACKETS, OTHER_MARK))
    codes = role_codes.where("diarizer_no is not null and role is not null").groupBy(F.col("diarizer_no").cast("int").alias("no")).agg(F.min("role").alias("named"))
    t2 = t2.withColumn("n1", _number(F.col("who"))).withColumn("n2", _number(F.col("label")))
    t2 = t2.join(codes.select(F.col("no").alias("n1"), F.col("named").alias("r1")), "n1", "left")
    t2 = t2.join(codes.select(F.col("no").alias("n2"), F.col("named").alias("r2")), "n2", "left")
    part = F.split("mark", ":")
    cue = F.aggregate(part, F.lit(0.0), lambda acc, x: acc * 60 + F.coalesce(F.regexp_replace(x, ",", ".").try_cast("double"), F.lit(0.0)))
    spoken = F.col("t").rlike(SURELY_SPOKEN) | F.regexp_replace("t", LONE_SOUND, " ").rlike(SPOKEN)
    speech = F.trim(F.regexp_replace(_replaced(F.col("t"), FILLER_SIGNS, FILLER), r"[\s\p{Z}]+", " "))
    return t2.select(
        "file_id",
        "seq",
        "start",
        F.when(F.col("mark") != "", cue).alias("cue"),
        F.coalesce(_role_word(F.col("who")), "r1", _role_word(F.col("label")), "r2").alias("role"),
        spoken.alias("spoken"),
        *([speech.alias("speech")] if words else []),
    )


# Strength of the edges: where two contradict each other, the weaker one goes.
TIMING, CUE, DIALOGUE = 3, 2, 1


def constraints(seq: list[int], start: list[float | None], cue: list[float | None]) -> list[tuple[int, int, int]]:
    """(strength, from, to) of the edges between the nodes of one block, numbered in order of arrival."""
    own = [c if s is None else s for s, c in zip(start, cue)]
    chain = sorted((i for i in range(len(seq)) if own[i] is not None), key=lambda i: (own[i], seq[i]))
    edges = [(CUE if start[u] is None or start[v] is None else TIMING, u, v) for u, v in zip(chain, chain[1:])]
    return edges + [(DIALOGUE, i, i + 1) for i in range(len(seq) - 1)]


def without_conflicts(edges: list[tuple[int, int, int]], own: list[float | None], seq: list[int], before: float | None) -> list[tuple[int, int, int]]:
    """The edges that are left when every dialogue edge that would close a cycle is dropped.

    ``v`` reaches ``u`` over stronger edges just if it lies before it in the chain; a node without a time lies where
    the edges into it put it, ``before`` being the time carried in from earlier arrivals.
    """
    kept = [e for e in edges if e[0] != DIALOGUE]
    reached = before if own and own[0] is None else own[0] if own else None
    for e in edges:
        if e[0] == DIALOGUE:
            _, u, v = e
            if own[v] is None:
                kept.append(e)
            else:
                last = (own[u] if own[u] is not None else reached, seq[u])
                if last[0] is None or last <= (own[v], seq[v]):
                    kept.append(e)
                reached = own[v]
    return kept


def topological(seq: list[int], own: list[float | None], edges: list[tuple[int, int, int]], before: float | None, after: float | None) -> tuple[list[int], list[float]]:
    """(nodes in order, time of each node): Kahn's algorithm, the least (time, seq) first among nodes that are free.

    A node without a time takes the greatest one among its predecessors, else ``before``; one that nothing precedes
    takes that of the first node behind it that has one, else ``after``, else 0.
    """
    n = len(seq)
    out: list[list[int]] = [[] for _ in range(n)]
    waiting = [0] * n
    for _, u, v in edges:
        out[u].append(v)
        waiting[v] += 1
    ahead, at = after if after is not None else 0.0, [0.0] * n
    first = [0.0] * n  # the time that a source without one takes from behind
    for i in range(n - 1, -1, -1):
        ahead = own[i] if own[i] is not None else ahead
        first[i] = ahead
    known: list[float | None] = list(own)
    heap = []
    for i in range(n):
        if not waiting[i]:
            at[i] = own[i] if own[i] is not None else before if before is not None else first[i]
            heap.append((at[i], seq[i], i))
    heapq.heapify(heap)
    order = []
    while heap:
        t, _, u = heapq.heappop(heap)
        order.append(u)
        for v in out[u]:
            if own[v] is None and (known[v] is None or known[v] < t):
                known[v] = t
            waiting[v] -= 1
            if not waiting[v]:
                at[v] = known[v]
                heapq.heappush(heap, (at[v], seq[v], v))
    return order, at


def _ordered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counting nodes of every block of arrivals with their times."""
    for b in batches:
        lists = b.column(1)
        rows = lists.flatten()
        sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        seq, role = rows.field("seq").to_numpy(zero_copy_only=False), rows.field("role").to_pylist()
        start, cue, spoken = (rows.field(c).to_pylist() for c in ("start", "cue", "spoken"))
        owner, picked, times, lo = [], [], [], 0
        for k, (n, before, after) in enumerate(zip(sizes, b.column(2).to_pylist(), b.column(3).to_pylist())):
            # copies of one segment that differ: the least one
            low = lambda x: (x is not None, x or 0)
            node: dict[int, int] = {}
            for i in range(lo, lo + n):
                s = int(seq[i])
                j = node.get(s)
                if j is None or (low(start[i]), low(cue[i]), role[i] or "", spoken[i]) < (low(start[j]), low(cue[j]), role[j] or "", spoken[j]):
                    node[s] = i
            lo += n
            q = sorted(node)
            at_of = [node[s] for s in q]
            st, cu = [start[i] for i in at_of], [cue[i] for i in at_of]
            own = [c if x is None else x for x, c in zip(st, cu)]
            edges = without_conflicts(constraints(q, st, cu), own, q, before)
            order, at = topological(q, own, edges, before, after)
            for u in order:
                if spoken[at_of[u]]:
                    owner.append(k)
                    picked.append(at_of[u])
                    times.append(at[u])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(owner, pa.int32())), pa.array(times, pa.float64()), rows.field("seq").take(pa.array(picked, pa.int64())), rows.field("role").take(pa.array(picked, pa.int64()))],
            ["file_id", "at", "seq", "role"],
        )


def ordered(df: DataFrame, role_codes: DataFrame) -> DataFrame:
    """Counting segments, each once, with the time that orders them: (file_id, block, at, seq, role)."""
    rows = cleaned(df, role_codes, words=False).withColumn("arrivals", F.floor(F.col("seq") / SEQ_BLOCK))
    # copies that agree collapse in the set, so a block holds one row an arrival and what differs
    blocks = rows.groupBy("file_id", "arrivals").agg(F.collect_set(F.struct("seq", "start", "cue", "role", "spoken")).alias("nodes"))
    blocks = cut_lineage(blocks)  # written once, as the summary of the blocks reads it too and cleaning is dear
    own = lambda x: F.coalesce(x["start"], x["cue"])
    known = F.transform(F.filter("nodes", lambda x: own(x).isNotNull()), lambda x: F.struct(x["seq"].alias("seq"), own(x).alias("own")))
    line = Window.partitionBy("file_id").orderBy("arrivals")
    edges = blocks.select("file_id", "arrivals", F.array_max(known)["own"].alias("last"), F.array_min(known)["own"].alias("first"))
    edges = edges.select(
        "file_id",
        "arrivals",
        F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # only a block whose first arrival has no time is reached by a dialogue edge that matters
    open_ = own(F.array_min("nodes")).isNull()
    none = F.lit(None).cast("double")
    closed = blocks.where(~open_).select("file_id", "nodes", none.alias("before"), none.alias("after"))
    reached = blocks.where(open_).join(edges.where("before is not null or after is not null"), ["file_id", "arrivals"], "left").select("file_id", "nodes", "before", "after")
    placed = closed.unionByName(reached).mapInArrow(_ordered_blocks, "file_id string, at double, seq bigint, role string")
    return placed.select("file_id", F.floor(F.col("at") / TIME_BLOCK).alias("block"), "at", "seq", "role")


def turn_starts(df: DataFrame, role_codes: DataFrame) -> DataFrame:
    """(file_id, seq) of the first segment of every turn."""
    w = Window.partitionBy("file_id", "block").orderBy("at", "seq")
    rows = ordered(df, role_codes).select("file_id", "block", "at", "seq", "role")
    known_before = F.last("role", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("known", known_before)
    per = rows.groupBy("file_id", "block").agg(
        F.collect_list(F.when(F.col("role") != F.col("known"), F.col("seq"))).alias("inner"),
        F.min(F.struct("at", "seq")).alias("head"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("at", "seq", "role"))).alias("opens"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "seq", "role")))["role"].alias("closes"),
    )
    line = Window.partitionBy("file_id").orderBy("block")
    per = per.withColumn("carried", F.last("closes", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("leads", F.row_number().over(line) == 1)
    head = F.when(F.col("leads"), F.col("head")["seq"])
    opens = F.when(F.col("opens").isNotNull() & (F.col("carried").isNull() | (F.col("carried") != F.col("opens")["role"])), F.col("opens")["seq"])
    seqs = F.array_distinct(F.array_compact(F.concat(F.array(head, opens), F.col("inner"))))
    return per.select("file_id", F.explode(seqs.cast("array<int>")).alias("seq"))


def turns(df: DataFrame, role_codes: DataFrame) -> DataFrame:
    """(file_id, turn, first_seq, role, segments, text): the clean turns of every file in the order spoken.

    Turns are numbered on rows without text; the cleaned texts then meet their turn by (file_id, seq).
    """
    key, order = ["file_id"], ["at", "seq"]
    # slim rows, written once, as every step reads them twice
    rows = blocked.filled(cut_lineage(ordered(df, role_codes)), key, "block", order, "role", "filled", backward=False)
    rows = blocked.neighbours(rows, key, "block", order, ["filled", "seq"])
    fresh = F.col("prev_seq").isNull() | ~F.col("filled").eqNullSafe(F.col("prev_filled"))
    rows = blocked.running_count(rows, key, "block", order, fresh, "turn").select("file_id", "seq", "at", "turn", "filled")
    # a filter on what is spoken would be pushed below and clean every text twice
    said = cleaned(df, role_codes).groupBy("file_id", "seq").agg(F.min(F.when(F.col("spoken"), F.col("speech"))).alias("speech"))
    at = F.struct("at", "seq")
    return (
        rows.join(said, ["file_id", "seq"])
        .groupBy("file_id", "turn")
        .agg(
            F.min(at)["seq"].cast("int").alias("first_seq"),
            F.first("filled").alias("role"),
            F.count("*").alias("segments"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "speech"))), lambda x: x["speech"]), " ").alias("text"),
        )
        .select("file_id", F.col("turn").cast("int").alias("turn"), "first_seq", "role", "segments", "text")
    )

"""Problem 5: personal information inside free text, found and replaced.

A text is rewritten by small transducers that keep, for every character they
emit, the span of source characters it stands for: half-width and look-alike
letters, composed syllables, plain dashes and spaces, nothing for invisible
characters, noises and hesitation, digits for spelled digits, and ``@`` and
``.`` for their disguises. Identifiers are detected in that form and their
spans are mapped back, so everything around them stays as it was.

Kinds: email, phone, id_number (resident or alien registration, passport,
driving licence), address (down to a building or plot), name (a full name).
Null, empty and blank texts hold none. Overlapping finds of two kinds keep the
one that begins first, the longer one of two that begin together.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.lookalike import SAME_SHAPE, invisible
from turnmill.llm.turns import NOISE_WORDS

# Family names of Korea in both scripts, and words that stand where a given name could but are none.
FAMILY = (
    "남궁 황보 제갈 사공 선우 서문 독고 동방 김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 전 홍 유 고 문 양 손 배 백 허 남 심 노 하 곽 성 차 주 우 구 민 류 나 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 왕 금 옥 육 인 맹 제 모 탁 국 어 은 편 용"
).split()
FAMILY_LATIN = (
    "Namgung Hwangbo Jegal Sagong Seonu Seomun Dokgo Dongbang Kim Gim Yi Lee Rhee Bak Park Pak Choe Choi Jeong Jung Chung Gang Kang Jo Cho Yun Yoon Jang Chang Im Lim Rim Han O Oh Seo Suh Sin Shin Gwon Kwon Hwang An Ahn Song Jeon Jun Hong Yu Yoo Go Ko Koh Mun Moon Yang Son Sohn Bae Baek Paik Heo Hur Nam Sim Shim No Noh Roh Ha Gwak Kwak Seong Sung Cha Ju Joo U Woo Gu Koo Min Ryu Na Ra Jin Ji Eom Um Chae Won Cheon Bang Gong Hyeon Hyun Ham Byeon Yeom Yeo Chu Do So Seok Seol Ma Gil Yeon Wi Pyo Myeong"
).split()
NO_GIVEN = "교수 선생 원장 간호 환자 의사 보호 부모 어머 아버 할머 할아 담당 과장 실장 기사 주치 약사 대기 접수 보험 병원 병동 어르 고객 본인 자녀 가족 치의 공의 문의".split()
DIGIT_WORDS = dict(zip("공영일이삼사오육칠팔구", "00123456789"))
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_SHAPES = {a: b for k, v in SAME_SHAPE.items() for a, b in zip(k, v)}
_DASH = set("‐‑‒–—―−﹣－˗")
_NOISES = "|".join(map(regex.escape, NOISE_WORDS))
_SKIP = regex.compile(
    rf"\s*(?:\(\(\s*(?:{_NOISES})\s*\)\)|[\[(<{{【*]\s*(?:{_NOISES})\s*[\])>}}】*]|[♩♪♫♬\U0001F3B5\U0001F3B6]+"
    r"|(?<![^\s])(?:[어음으흠]+|아+|에+|[Uu]+[hm]+|그|저)(?:\s*(?:\.{2,}|…)[.…]*,?|,))(?=\s)"
)


#: What ``plain`` can change, and separators that not every engine takes for white space. The ellipsis, which becomes
#: three dots, is left to ``SKIPPED``: nothing else asks for dots.
ODD = r"[^\x00-\x1B\x20-\x7E가-힣…]"
_ODD = regex.compile(r"[^\x00-\x7E가-힣]")


class Aligned:
    """A text in its plain form, with the source span of every character of it."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: list[int], end: list[int]):
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]

    def replaced(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """With stretches rewritten; each new character stands for the whole stretch unless lengths agree."""
        if not edits:
            return self
        out, start, end, at = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            out.append(new)
            if len(new) == b - a:
                start += self.start[a:b]
                end += self.end[a:b]
            else:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        return Aligned("".join(out), start + self.start[at:], end + self.end[at:])


def plain(text: str) -> Aligned:
    """Character by character: width, shape, dashes, spaces, invisible characters, composition."""
    if not _ODD.search(text):
        return Aligned(text, list(range(len(text))), list(range(1, len(text) + 1)))
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    for i, c in enumerate(text):
        if c < "\x7f" or "가" <= c <= "힣":
            forms = c
        elif invisible(c):
            if end:
                end[-1] = i + 1
            continue
        elif c in _DASH:
            forms = "-"
        elif c in _SHAPES:
            forms = _SHAPES[c]
        elif ud.category(c) == "Zs":
            forms = " "
        elif out and (ud.combining(c) or 0x1160 <= ord(c) <= 0x11FF):
            joined = ud.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1], end[-1] = joined, i + 1
                continue
            forms = c
        else:
            forms = ud.normalize("NFKC", c)
        for f in forms:
            out.append(f)
            start.append(i)
            end.append(i + 1)
    return Aligned("".join(out), start, end)


_SPELLED = regex.compile(r"(?<![가-힣])[공영][공영일이삼사오육칠팔구]{1,2}(?:[ .-]*[공영일이삼사오육칠팔구]{3,4}){2}|(?<![가-힣])[공영일이삼사오육칠팔구]{6}[ -]*[일이삼사오육칠팔][공영일이삼사오육칠팔구]{6}")
_AT = regex.compile(r"(?<=[A-Za-z0-9])\s*(?:[(\[]\s*(?:at|골뱅이)\s*[)\]]|골뱅이|앳|@)\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+)", regex.I)
_DOT = regex.compile(r"(?<=[A-Za-z0-9])\s*(?:[(\[]\s*(?:dot|점)\s*[)\]]|(?<=\s)(?:점|닷|dot)(?=\s))\s*(?=[A-Za-z0-9])", regex.I)


def deobfuscate(text: str) -> Aligned:
    """The plain form without noises, with spelled digits as digits and undisguised addresses of mail."""
    a = plain(text)
    a = a.replaced([(*m.span(), "") for m in _SKIP.finditer(a.text)])
    a = a.replaced([(*m.span(), "".join(DIGIT_WORDS.get(c, c) for c in m.group())) for m in _SPELLED.finditer(a.text)])
    if _AT.search(a.text):
        a = a.replaced([(*m.span(), "@") for m in _AT.finditer(a.text)])
        a = a.replaced([(*m.span(), ".") for m in _DOT.finditer(a.text)])
    return a


_EMAIL = regex.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_PHONE = regex.compile(r"(?<![\dA-Za-z.-])(?:\+ ?82[ .-]?(?:\(0\) ?)?(?:1\d|2|[3-7]\d)|\(0(?:1\d|2|[3-7]\d)\)|0(?:1\d|2|[3-7]\d))[ .-]{0,2}\d{3,4}[ .-]{0,2}\d{4}(?![\d-])")
_RESIDENT = regex.compile(r"(?<![\d-])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ .-]{0,3}[1-8]\d{6}(?![\d-])")
_PASSPORT = regex.compile(r"(?<![A-Za-z\d-])[MSRGDTO](?:\d{8}|\d{3}[A-Z]\d{4})(?![\d-])")
_LICENCE = regex.compile(r"(?<![\d-])\d{2}[ -]\d{2}[ -]\d{6}[ -]\d{2}(?![\d-])")
#: Words before a number that make it one of a sample, lot, reception or product.
_THING = regex.compile(r"(?:검체|로트|접수|바코드|제품|수납|예약|처방|시리얼|모델|품목|송장|주문|영수증|대기|차트)\s*(?:번호)?[:\s]*$")
_AREA = r"(?:[가-힣]{2,}(?:특별시|광역시|시|도)\s+)?(?:[가-힣]{2,}(?:시|군|구)\s+)?(?:[가-힣]{2,}(?:구|읍|(?<![하되으라])면|동)\s+)?"
_UNIT = r"(?:,?\s*\d+동(?:\s*\d+층)?\s*\d+호|,?\s*\d+(?:층|호)(?![가-힣]))?"
_END = r"(?=\s*(?:$|[,.?!)]|쪽|에|로|이|예|입|순서|맞|으|번지|근처|앞|인데|라고|집|주소))"
_ROAD = regex.compile(rf"(?<![가-힣]){_AREA}[가-힣]{{2,}}(?:대로|로|길)(?:\s?\d+번?길)?\s?\d+(?:-\d+)?(?![\d:/.]){_UNIT}{_END}")
_LOT = regex.compile(rf"(?<![가-힣]){_AREA}[가-힣]{{1,}}(?:동|리|가)\s+(?:산\s*)?\d+(?:-\d+)?\s*번지{_UNIT}")
_LATIN_PLACE = regex.compile(r"(?<![\w-])\d+(?:-\d+)?,? [A-Z][a-z]+-(?:ro|gil|daero)(?: \d+(?:beon)?-gil)?(?:, [A-Z][a-z]+(?:-(?:gu|si|dong|eup|myeon|gun|do)| City))*")
_GIVEN_KO = rf"(?!(?:{'|'.join(NO_GIVEN)}))[가-힣]{{2}}"
_FULL_KO = rf"(?:{'|'.join(FAMILY)})\s?{_GIVEN_KO}"
_LATIN = r"[A-Z][a-z]+(?:-[A-Za-z][a-z]+)?"
_FULL_EN = rf"(?:(?:{'|'.join(FAMILY_LATIN)}) {_LATIN}|{_LATIN} (?:{'|'.join(FAMILY_LATIN)})(?![a-z]))"
_CAPITALS = rf"(?:(?:{'|'.join(x.upper() for x in FAMILY_LATIN)}) [A-Z]{{2,}}(?:-[A-Z]{{2,}})?)(?![A-Za-z])"
_FULL = rf"(?:{_FULL_KO}|{_FULL_EN}|{_CAPITALS})"
_NAMED = regex.compile(
    rf"(?<![가-힣A-Za-z])(?P<n>{_FULL})(?=\s+(?:(?:님|씨)(?:이|가|은|는|을|를|도|께서|께|의|와|과|랑|이랑|한테|에게|만)?|(?:환자|보호자|어르신)분?)(?![가-힣]))"
    rf"|(?:이름|성함|성명|존함)\s*(?:은|는|이|가|을|:)?\s*(?P<n>{_FULL})(?=\s*(?:[,.?!]|이고|이며|이랑|하고|입니다|이에요|예요|인데|이라고|라고|님|씨))"
    rf"|(?:동의서|서류|신청서|명단)에는?\s+(?P<n>{_FULL})(?=\s*,)"
    rf"|(?<![가-힣])(?P<n>(?:{'|'.join(FAMILY)}){_GIVEN_KO})(?=(?:님|씨)(?:[ ,.?!]|$))"
    rf"|담당(?:자|의|의사)?(?:은|는)\s+(?P<n>{_FULL_KO})(?=\s*(?:입니다|이에요|예요|이고|이며|[,.?!]|$))"
    rf"|(?i:name(?: is|:)|I am|I'm|this is)\s+(?P<n>{_FULL_EN}|{_CAPITALS})(?![\w-])"
)
#: Nothing is a name without one of these.
NAME_CUE = r"\s(?:님|씨|환자|보호자|어르신)|이름|성함|성명|존함|동의서|서류|신청서|명단|[가-힣]{3}(?:님|씨)(?:[ ,.?!…]|$)|담당|(?i:name|I am|I'm|this is)"
_NAME_CUE = regex.compile(NAME_CUE)


#: The least digits that an identifier has, and the numbers of an address.
DIGITS = r"^(?:[^0-9]*+[0-9]){7}"
PLACE_CUE = r"[로길]\s?\d|번지|\d,? [A-Z][a-z]+-"
_DIGITS, _PLACE_CUE = regex.compile(DIGITS), regex.compile(PLACE_CUE)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every find, in source characters, ascending and apart."""
    if not text or not text.strip():
        return []
    # most texts are their own plain form and need no map back
    a = deobfuscate(text) if _CHANGED.search(text) else None
    t = text if a is None else a.text
    hits: list[tuple[int, int, str]] = []
    if "@" in t:
        hits += [(*m.span(), "email") for m in _EMAIL.finditer(t)]
    if _DIGITS.search(t):
        for kind, patterns in (("id_number", (_LICENCE, _RESIDENT, _PASSPORT)), ("phone", (_PHONE,))):
            for p in patterns:
                hits += [(*m.span(), kind) for m in p.finditer(t) if not _THING.search(t, max(0, m.start() - 20), m.start())]
    if _PLACE_CUE.search(t):
        for p in (_ROAD, _LOT, _LATIN_PLACE):
            hits += [(*m.span(), "address") for m in p.finditer(t)]
    if _NAME_CUE.search(t):
        hits += [(*m.span("n"), "name") for m in _NAMED.finditer(t)]
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(hits, key=lambda h: (h[0], -h[1])):
        if a is not None:
            s, e = a.span(s, e)
        if not out or s >= out[-1][1]:
            out.append((s, e, kind))
    return out


def redact(text: str | None) -> str | None:
    """The text with a typed placeholder in each place; null stays null."""
    spans = find(text)
    if not spans:
        return text
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*parts, text[at:]])


# What a text must hold to be looked at. A text that no transducer can change is its own plain form, so it needs what
# the detectors need; any other text is looked at whatever it holds. Hence no find is lost; tests hold ``find`` to it.
#: A noise in brackets, or a hesitation.
SKIPPED = r"[\[(<{*]|[어음으흠아에그저hm]\s*(?:\.\.|…|,)"
#: A spelled number has a group of three.
SPELLED = r"[공영일이삼사오육칠팔구]{3}"
MAIL_CUE = r"@|골뱅이|앳|(?i:\sat\s)"
CHANGED = "|".join((ODD, SKIPPED, SPELLED, MAIL_CUE))
SUSPECT = "|".join((CHANGED, PLACE_CUE, NAME_CUE, DIGITS))
_CHANGED = regex.compile("|".join((ODD, SKIPPED, SPELLED, MAIL_CUE, "…")))


def suspect(c: Column) -> Column:
    return F.coalesce(c.rlike(SUSPECT), F.lit(False))


def kinds(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Keys and kind, one row for each row of ``df`` and kind found in its text."""
    rows = df.where(suspect(F.col(text))).select(*keys, F.col(text).alias("__text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({k for _, _, k in find(t)}) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*keys, "__kinds"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(search, f"{types}, __kinds array<string>").select(*keys, F.explode("__kinds").alias("kind"))


def redacted(df: DataFrame, column: str) -> DataFrame:
    """``df`` with typed placeholders in the column; every row stays, all else unchanged."""

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    c = F.col(column)
    return df.withColumn(column, F.coalesce(put(F.when(suspect(c), c)), c))

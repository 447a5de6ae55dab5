"""Queries of cleaning pipelines, rewrite rules, misheard words and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.plans import joined
from turnmill.functions import cleaning as C
from turnmill.functions import text as T
from turnmill.operators import detection as D
from turnmill.operators import joins as J
from turnmill.operators import rules as R
from turnmill.operators import sequences as S
from turnmill.plans.evaluation import TEXTS_SQL, texts
from turnmill.plans.sequences import SEGMENTS_SQL, segments
from turnmill.session import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _said(s, d):
    return segments(s, d).where("text is not null")


def _entries(s, d):
    return table(s, d, "medical_dict_entries")


def _each(name, column, sql=None, of="SELECT * FROM seg WHERE text IS NOT NULL"):
    """A query of a text function over all segments."""
    full = sql and f"WITH {SEGMENTS_SQL}, x AS ({of}) SELECT file_id, seq, {sql} AS text FROM x"
    query(name, full)(lambda s, d: _said(s, d).select("file_id", "seq", column(F.col("text")).alias("text")))


# cleaning -----------------------------------------------------------------


def _chain(x, steps):
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"
_PARTS = lambda x: f"string_split(regexp_replace({x}, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("t1_processed")
def _(s, d):
    """The pipeline up to the dictionary, with its log as numbers of changes by kind."""
    x = _said(s, d).select("file_id", "seq", C.processed(F.col("text")).alias("x")).select("file_id", "seq", "x.text", "x.changes")
    kinds = ("hallucination", "filler", "number", "punctuation")
    count = lambda k: F.size(F.filter("changes", lambda c: c["kind"] == k)).alias(f"{k}s")
    return x.select("file_id", "seq", "text", *map(count, kinds))


@query("t2_segments")
def _(s, d):
    """Cleaned segments that hold something, without consecutive repeats."""
    x = _said(s, d).where("text <> ''").select("file_id", "seq", C.processed(F.col("text"))["text"].alias("text"))
    return S.without_repeats(x.where(T.valid_segment(F.col("text"), 1))).select("file_id", "seq", "text")


_each("t3_made_up_speech", C.without_made_up_speech)
_each("t4_engine_repeats", C.engine_repeats)
_each("t5_without_sequences", C.without_sequences, f"CASE WHEN length({{0}}) < 2 THEN '' ELSE {{0}} END".format(f"trim(regexp_replace({_chain('text', [(C.IMPOSSIBLE[1], ''), (C.IMPOSSIBLE[0], ''), (C.IMPOSSIBLE[2], '')])}, '\\s+', ' ', 'g'), ' ')"))

# a sound on its own is a word that is it, or begins with it before a mark; words and blanks apart need no look behind
_ALONE = lambda x, c: f"array_to_string(list_transform(regexp_extract_all({x}, '\\S+|\\s+'), lambda w: regexp_replace(w, '^{c}([,.]|$)', '\\1')), '')"
_SOUNDS = _chain("text", [(p, "") for p in C.REPEATED_SOUNDS + C.SINGLE_SOUNDS[:7]])
_SOUNDS = _ALONE(_ALONE(_ALONE(_SOUNDS, "음"), "어"), "그")
_each("t6_hesitation", C.without_fillers, _TRIM(f"regexp_replace({_SOUNDS}, '(?:{'|'.join(c + '{3,}' for c in '네예아어으음')})\\s*(?:[.!?]?\\s*)$', '')"))
_each("t7_spoken_numbers", C.spoken_numbers)
_each("t13_punctuation", C.punctuation, "CASE WHEN regexp_matches({0}, '[가-힣a-zA-Z0-9]\\s*$') THEN regexp_replace({0}, '\\s+$', '') || '.' ELSE {0} END".format(_chain("text", [(p.pattern, to) for _, p, to in C._MARKS])))
_ASKS = f"'{'|'.join(C.QUESTIONS)}'"
_CORE = _TRIM("left(y, length(y) - 1)")
_each(
    "t15_question_marks",
    C.question_marks,
    f"array_to_string(list_filter(list_transform(list_transform({_PARTS('text')}, lambda p: {_TRIM('p')}), lambda y: CASE WHEN ends_with(y, '.') AND regexp_matches({_CORE}, {_ASKS}) THEN {_CORE} || '?' WHEN y <> '' AND NOT ends_with(y, '?') AND NOT ends_with(y, '.') AND NOT ends_with(y, '!') AND regexp_matches(y, {_ASKS}) THEN y || '?' ELSE y END), lambda y: y <> ''), ' ')",
)
_CONTEXT = "text"
for _c, _p, _to in C.CONTEXT:
    _CONTEXT = f"CASE WHEN regexp_matches(text, '{_c}') THEN regexp_replace({_CONTEXT}, '{_p}', '{_to.replace('$', chr(92))}', 'g') ELSE {_CONTEXT} END"
_each("t16_context", lambda c: C.in_context(c, C.CONTEXT, around=c), _CONTEXT)
_each("t17_rescored", C.in_context_and_possible, f"trim(regexp_replace({_chain(_CONTEXT, [(p, '') for p in C.IMPOSSIBLE])}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')")
_each("seq17_sentences_once", C.without_repeated_sentences, f"array_to_string(list_filter(list_transform({_PARTS('text')}, lambda p, i: CASE WHEN i > 1 AND {_TRIM('p')} = {_TRIM(_PARTS('text') + '[i - 1]')} THEN NULL ELSE p END), lambda p: p IS NOT NULL), ' ')")
_each("t14_whitespace", T.squeeze, "trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')")
_each("t24_sanitised", C.sanitised, "replace(text, chr(0), '')")
_each("t27_ellipsis", lambda c: F.when(F.length(c) > 60, F.concat(F.left(c, F.lit(60)), F.lit("..."))).otherwise(c), "CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END")


@query("t18_polished")
def _(s, d):
    correct = R.Corrector(R.ordered_rules(_entries(s, d), ["exact", "regex", "phonetic"]))
    return _said(s, d).select("file_id", "seq", C.polished(F.col("text"), lambda t: correct(t)[0]).alias("text"))


@query("t19_enhanced")
def _(s, d):
    entries = [(r["wrong"], r["correct"], r["hints"]) for r in R.ordered_rules(_entries(s, d), ["exact", "regex", "phonetic"])]
    return texts(s, d).where("hypothesis is not null").select("result_id", C.enhanced_column(F.col("hypothesis"), entries).alias("text"))


_FENCE = "trim(regexp_replace(regexp_replace({}, '^\\s*```[a-zA-Z]*\\s*', ''), '\\s*```\\s*$', ''), ' ')"


@query("t25_fences", "SELECT doc_id, " + _FENCE.format("'```json' || chr(10) || text || chr(10) || '```'") + " AS fenced, " + _FENCE.format("text") + " AS bare FROM documents WHERE text IS NOT NULL")
def _(s, d):
    c = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", C.without_fences(F.concat(F.lit("```json\n"), c, F.lit("\n```"))).alias("fenced"), C.without_fences(c).alias("bare"))


_NUMERAL = "regexp_extract_all(text, '([영일이삼사오육칠팔구십백천만]+)', 1)"


@query("t8_sino_numbers", f"""WITH {SEGMENTS_SQL}, w AS (SELECT DISTINCT unnest({_NUMERAL}) AS word FROM seg),
 f AS (SELECT word, list_reduce(list_transform(string_split(word, ''), lambda c: struct_pack(c := c, total := 0::BIGINT, held := 0::BIGINT)), lambda a, r: struct_pack(c := r.c,
  total := CASE r.c WHEN '만' THEN (a.total + CASE WHEN a.held = 0 AND a.total > 0 THEN 0 ELSE greatest(a.held, 1) END) * 10000 WHEN '천' THEN a.total + greatest(a.held, 1) * 1000 WHEN '백' THEN a.total + greatest(a.held, 1) * 100 WHEN '십' THEN a.total + greatest(a.held, 1) * 10 ELSE a.total END,
  held := CAST(greatest(strpos('영일이삼사오육칠팔구', r.c) - 1, 0) AS BIGINT)), struct_pack(c := '', total := 0::BIGINT, held := 0::BIGINT)) AS f FROM w)
SELECT word, nullif(f.total + f.held, 0) AS value FROM f""")
def _(s, d):
    words = segments(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("([영일이삼사오육칠팔구십백천만]+)"), 1)).alias("word")).distinct()
    return words.select("word", T.sino_number(F.col("word")).alias("value"))


# words --------------------------------------------------------------------


def _stem_sql(w):
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{p}') AND length({w}) > {len(p) + 1} THEN left({w}, length({w}) - {len(p)})" for p in D.PARTICLES) + f" ELSE {w} END"


def _differs_sql(a, b):
    """``only_particle_differs`` of columns a and b with their stems sa and sb."""
    return f"""(s{a} = s{b} OR s{a} = {b} OR {a} = s{b} OR {a} = {b} OR (s{a} <> {a} AND starts_with({b}, s{a}) AND length({b}) - length(s{a}) <= 1)
 OR (length({a}) = length({b}) AND length({a}) >= 3 AND left({a}, length({a}) - 1) = left({b}, length({b}) - 1) AND contains('{C.LAST_PARTICLES}', right({a}, 1))))"""


_LETTERS = sorted({c for c in T.LEADS + T.VOWELS + T.TAILS if c.strip()})
#: A byte for each letter of Korean, so that a distance of bytes is one of letters; none is a letter, digit, quote or line end.
_BYTES = [c for c in map(chr, [*range(1, 10), 11, 12, *range(14, 32), *b"!#$%&()*+,-./:;<=>?@[]^_"])][: len(_LETTERS)]


def _jamo_sql(w):
    part = "CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN substr('" + T.LEADS + "', (unicode(c) - 44032) // 588 + 1, 1) || substr('" + T.VOWELS + "', ((unicode(c) - 44032) % 588) // 28 + 1, 1) || CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN substr('" + T.TAILS + "', (unicode(c) - 44032) % 28 + 1, 1) ELSE '' END ELSE c END"
    return f"translate(array_to_string(list_transform(list_filter(string_split({w}, ''), lambda x: x <> ''), lambda c: {part}), ''), '{''.join(_LETTERS)}', {' || '.join(f'chr({ord(b)})' for b in _BYTES)})"


def _similar_sql(words, vocabulary):
    """CTEs ``sim``: the most similar terms of the words, as (word, term, specialty, similarity, place)."""
    return f"""jw AS (SELECT DISTINCT word, {_jamo_sql('word')} AS wj FROM {words} WHERE length(word) >= 2), jv AS (SELECT term, min(specialty) AS specialty, {_jamo_sql('term')} AS tj FROM {vocabulary} WHERE term IS NOT NULL GROUP BY term),
 pr AS (SELECT word, term, specialty, 1 - levenshtein(wj, tj) / greatest(length(wj), length(tj)) AS similarity FROM jw JOIN jv ON abs(length(term) - length(word)) <= greatest(length(word) // 2, 2)),
 sim AS (SELECT word, term, specialty, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY word ORDER BY similarity DESC, term) AS INTEGER) AS place FROM pr WHERE similarity >= 0.6)"""


_VOCABULARY = "voc AS (SELECT DISTINCT correct AS term, category AS specialty FROM medical_dict_entries WHERE correct IS NOT NULL)"
_WRONG = "wrongs AS (SELECT wrong AS word FROM medical_dict_entries WHERE wrong IS NOT NULL)"


def _vocabulary(s, d):
    return _entries(s, d).where("correct is not null").select(F.col("correct").alias("term"), F.col("category").alias("specialty")).distinct()


def _wrongs(s, d):
    return _entries(s, d).where("wrong is not null").select(F.col("wrong").alias("word"))


@query("m12_jamo_similarity", f"SELECT id, round(1 - levenshtein({_jamo_sql('wrong')}, {_jamo_sql('correct')}) / greatest(length({_jamo_sql('wrong')}), length({_jamo_sql('correct')})), 6) AS similarity FROM medical_dict_entries")
def _(s, d):
    return _entries(s, d).select("id", F.round(T.jamo_similarity(F.col("wrong"), F.col("correct")), 6).alias("similarity"))


@query("j2_similar_words", f"WITH {_VOCABULARY}, {_WRONG}, {_similar_sql('wrongs', 'voc')} SELECT word, term, similarity, place FROM sim WHERE place <= 3")
def _(s, d):
    return J.similar_words(_wrongs(s, d), _vocabulary(s, d).select("term"))


@query("s2_best_term", f"WITH {_VOCABULARY}, {_WRONG}, {_similar_sql('wrongs', 'voc')} SELECT word, term, similarity FROM sim WHERE place = 1")
def _(s, d):
    return J.similar_words(_wrongs(s, d), _vocabulary(s, d).select("term"), top=1).drop("place")


_DRUG = "(SELECT min(specialty) FROM voc)"


@query("j3_scoped_or_all", f"""WITH {_VOCABULARY}, {_WRONG}, ins AS (SELECT * FROM voc WHERE specialty = {_DRUG}), a AS (SELECT * FROM (WITH {_similar_sql('wrongs', 'ins')} SELECT * FROM sim WHERE place <= 3)), rest AS (SELECT word FROM wrongs WHERE word NOT IN (SELECT word FROM a)), b AS (SELECT * FROM (WITH {_similar_sql('rest', 'voc')} SELECT * FROM sim WHERE place <= 3))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(s, d):
    """Terms of one specialty, the first by name; words without any there are looked up among all."""
    scope = _vocabulary(s, d).agg(F.min("specialty")).first()[0]
    return D.candidates(_wrongs(s, d), _vocabulary(s, d), scope)


@query("j4_scoped_candidates", f"""WITH {_VOCABULARY}, {_WRONG}, two AS (SELECT DISTINCT specialty FROM voc ORDER BY specialty LIMIT 2), o AS (SELECT specialty, row_number() OVER (ORDER BY specialty) AS o FROM two),
 {_similar_sql('wrongs', 'voc')}, sc AS (SELECT s.word, s.term, s.specialty, s.similarity, o.o, round(s.similarity + CASE WHEN o.o = 1 THEN 0.02 ELSE 0.0 END, 6) AS score FROM sim s JOIN o USING (specialty) WHERE s.place <= 10)
SELECT word, term, specialty, score, CAST(row_number() OVER (PARTITION BY word ORDER BY score DESC, o, term) AS INTEGER) AS place FROM sc QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, o, term) <= 3""")
def _(s, d):
    """Among the ten most similar terms those of two specialties, the first by name weighing a little more."""
    two = [r[0] for r in _vocabulary(s, d).select("specialty").distinct().orderBy("specialty").limit(2).collect()]
    hits = D.candidates(_wrongs(s, d), _vocabulary(s, d), top=10).drop("place")
    return D.scoped(hits, two).select("word", "term", "specialty", "score", "place")


_SAID = f"{TEXTS_SQL}, said AS (SELECT word, count(*) AS times FROM (SELECT unnest(regexp_extract_all(hypothesis, '[가-힣]{{2,}}')) AS word FROM texts) GROUP BY word)"


@query("j5_known_words", f"WITH {_SAID} SELECT word, times FROM said WHERE word IN (SELECT correct FROM medical_dict_entries WHERE correct IS NOT NULL)")
def _(s, d):
    """Words said that are terms of the vocabulary, with how often."""
    said = texts(s, d).select(F.explode(F.regexp_extract_all("hypothesis", F.lit("([가-힣]{2,})"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    return said.join(_vocabulary(s, d).select(F.col("term").alias("word")), "word", "left_semi")


@query("t20_without_particles", f"SELECT DISTINCT word, {_stem_sql('word')} AS stem FROM (SELECT unnest(regexp_extract_all(text, '[가-힣]{{2,}}')) AS word FROM transcribe_segments)")
def _(s, d):
    w = table(s, d, "transcribe_segments").select(F.explode(F.regexp_extract_all("text", F.lit("([가-힣]{2,})"), 1)).alias("word")).distinct()
    return w.select("word", T.without_particle(F.col("word"), D.PARTICLES).alias("stem"))


@query("t21_particle_differs", f"""WITH p AS (SELECT id, wrong AS a, correct AS b FROM medical_dict_entries UNION ALL SELECT id, correct || p, correct FROM medical_dict_entries, (VALUES ('이'), ('에서'), ('염'), ('')) v(p)), s AS (SELECT *, {_stem_sql('a')} AS sa, {_stem_sql('b')} AS sb FROM p)
SELECT id, a, b, {_differs_sql('a', 'b')} AS differs FROM s""")
def _(s, d):
    e = _entries(s, d)
    made = e.select("id", F.explode(F.array(*map(F.lit, ("이", "에서", "염", "")))).alias("p"), "correct")
    pairs = e.select("id", F.col("wrong").alias("a"), F.col("correct").alias("b")).unionByName(made.select("id", F.concat("correct", "p").alias("a"), F.col("correct").alias("b")))
    return pairs.withColumn("differs", C.only_particle_differs(F.col("a"), F.col("b"), D.PARTICLES))


_SAFE = "(" + ", ".join(f"'{w}'" for w in D.SAFE_WORDS) + ")"
_MISHEARD = f"""{_SAID}, {_VOCABULARY}, known AS (SELECT wrong AS word FROM medical_dict_entries WHERE enabled AND wrong IS NOT NULL UNION SELECT correct FROM medical_dict_entries WHERE enabled AND correct IS NOT NULL),
 w AS (SELECT word, {_stem_sql('word')} AS stem FROM said WHERE length(word) >= 2), left_ AS (SELECT word FROM w WHERE word NOT IN {_SAFE} AND stem NOT IN {_SAFE} AND word NOT IN (SELECT word FROM known) AND word NOT IN (SELECT term FROM voc) AND stem NOT IN (SELECT term FROM voc)),
 {_similar_sql('left_', 'voc')}, b AS (SELECT *, {_stem_sql('word')} AS sword, {_stem_sql('term')} AS sterm FROM sim WHERE place = 1),
 found AS (SELECT word, term, specialty, similarity, CASE WHEN similarity >= 0.85 THEN 'replace' WHEN similarity >= 0.7 THEN 'review' ELSE 'ignore' END AS action FROM b WHERE NOT {_differs_sql('word', 'term')} AND term NOT IN {_SAFE})"""


def _misheard(s, d):
    words = texts(s, d).select(F.explode(F.regexp_extract_all("hypothesis", F.lit("([가-힣]{2,})"), 1)).alias("word")).distinct()
    return D.misheard(words, _vocabulary(s, d), _entries(s, d))


@query("c8_misheard_words", f"WITH {_MISHEARD} SELECT * FROM found")
def _(s, d):
    return _misheard(s, d)


_APPLIED = f"""{_MISHEARD}, pos AS (SELECT result_id, w[i] AS word, min(i) AS nth FROM (SELECT result_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT result_id, regexp_extract_all(hypothesis, '[가-힣]{{2,}}') AS w FROM texts)) GROUP BY result_id, word),
 hit AS (SELECT result_id, list(struct_pack(w := word, t := term, a := action, text := '', n := 0::BIGINT, p := 0::BIGINT) ORDER BY nth) AS hits FROM pos JOIN found USING (word) WHERE action <> 'ignore' GROUP BY result_id),
 done AS (SELECT result_id, CASE WHEN hits IS NULL THEN struct_pack(w := '', t := '', a := '', text := hypothesis, n := 0::BIGINT, p := 0::BIGINT) ELSE list_reduce(hits, lambda acc, h: struct_pack(w := h.w, t := h.t, a := h.a, text := CASE WHEN h.a = 'replace' THEN replace(acc.text, h.w, h.t) ELSE acc.text END, n := acc.n + CASE WHEN h.a = 'replace' AND contains(acc.text, h.w) THEN 1 ELSE 0 END, p := acc.p + CASE WHEN h.a = 'review' THEN 1 ELSE 0 END), struct_pack(w := '', t := '', a := '', text := hypothesis, n := 0::BIGINT, p := 0::BIGINT)) END AS f FROM texts LEFT JOIN hit USING (result_id) WHERE hypothesis IS NOT NULL)"""


@query("c9_applied", f"WITH {_APPLIED} SELECT result_id, f.text AS text, CAST(f.n AS INTEGER) AS replaced, CAST(f.p AS INTEGER) AS pending FROM done")
def _(s, d):
    """Second tier over all texts: sure words replaced, unsure ones logged."""
    t = texts(s, d).where("hypothesis is not null")
    x = D.applied(t, _misheard(s, d), ["result_id"], "hypothesis")
    return x.select("result_id", "text", "replaced", "pending")


_LEARNED = f"""{_MISHEARD}, sure AS (SELECT word AS wrong, min(term) AS correct FROM found WHERE action = 'replace' GROUP BY word), st AS (SELECT *, {_stem_sql('wrong')} AS swrong, {_stem_sql('correct')} AS scorrect FROM sure),
 new AS (SELECT wrong, correct, CAST(50 + length(wrong) AS INTEGER) AS priority FROM st WHERE wrong <> correct AND wrong NOT IN {_SAFE} AND NOT {_differs_sql('wrong', 'correct')} AND NOT ((contains(correct, wrong) OR contains(wrong, correct)) AND abs(length(wrong) - length(correct)) <= 2) AND wrong NOT IN (SELECT wrong FROM medical_dict_entries WHERE wrong IS NOT NULL))"""


@query("c10_learnable", f"WITH {_LEARNED} SELECT new.*, f.specialty AS category, 'auto (similarity ' || printf('%.2f', f.similarity) || ', source=auto)' AS notes FROM new JOIN found f ON f.word = new.wrong")
def _(s, d):
    return D.learned(_misheard(s, d), _entries(s, d))


@query("c11_review_queue", f"WITH {_MISHEARD} SELECT word, term, similarity, CASE WHEN similarity >= 0.8 THEN 'approved' ELSE 'pending' END AS status FROM found WHERE action = 'review'")
def _(s, d):
    found = _misheard(s, d)
    empty = found.limit(0).select("word", "term", "similarity", F.lit("pending").alias("status"))
    queue = D.queued(empty, found)
    return D.decided(queue, queue.where("similarity >= 0.8").withColumn("status", F.lit("approved")))


@query("pf10_settled_reviews", f"WITH {_MISHEARD} SELECT word, term, 'approved' AS status FROM found WHERE action = 'review' AND similarity >= 0.8")
def _(s, d):
    return QUERIES["c11_review_queue"](s, d).where("status <> 'pending'").select("word", "term", "status")


# rules --------------------------------------------------------------------


def _fold_sql(strategies, near):
    """Rules as a list that a text is reduced over; ``near`` tells whether a hint is met, of acc and r."""
    return f"""{TEXTS_SQL}, rl AS (SELECT list(struct_pack(id := id, w := wrong, c := correct, h := coalesce(context_hint, CAST([] AS VARCHAR[])), text := '', applied := CAST([] AS VARCHAR[])) ORDER BY coalesce(priority, 50) DESC, length(wrong) DESC, id) AS rules FROM medical_dict_entries WHERE enabled AND strategy IN ({strategies}) AND wrong <> '' AND correct IS NOT NULL),
 f AS (SELECT result_id, list_reduce(rules, lambda acc, r: CASE WHEN contains(acc.text, r.w) AND r.w <> r.c AND (len(r.h) = 0 OR len(list_filter(r.h, lambda h: {near})) > 0) THEN struct_pack(id := r.id, w := r.w, c := r.c, h := r.h, text := replace(acc.text, r.w, r.c), applied := list_append(acc.applied, r.id)) ELSE acc END,
  struct_pack(id := '', w := '', c := '', h := CAST([] AS VARCHAR[]), text := hypothesis, applied := CAST([] AS VARCHAR[]))) AS f FROM texts, rl WHERE hypothesis IS NOT NULL)
SELECT result_id, f.text AS text, f.applied AS applied FROM f"""


_POS = "(strpos(acc.text, r.w) - 1)"
_AROUND = f"contains(lower(substring(acc.text, CAST(greatest({_POS} - 30, 0) + 1 AS BIGINT), CAST(least({_POS} + 30, length(acc.text)) - greatest({_POS} - 30, 0) AS BIGINT))), lower(h))"
_ANY = "'exact', 'phonetic', 'regex'"


def _exact(s, d, strategies, reach):
    r = R.ordered_rules(_entries(s, d), strategies)
    x = texts(s, d).where("hypothesis is not null").select("result_id", R.exact(F.col("hypothesis"), r, reach).alias("x"))
    return x.select("result_id", "x.text", "x.applied")


@query("c2_exact_rules", f"WITH {_fold_sql(chr(39) + 'exact' + chr(39), _AROUND)}")
def _(s, d):
    return _exact(s, d, ["exact"], R.REACH)


@query("c3_hints_near", f"WITH {_fold_sql(_ANY, _AROUND)}")
def _(s, d):
    """All rules taken for exact ones, so that those with hints meet them within thirty characters."""
    return _exact(s, d, ["exact", "phonetic", "regex"], R.REACH)


@query("c6_hints_anywhere", f"WITH {_fold_sql(_ANY, 'contains(lower(acc.text), lower(h))')}")
def _(s, d):
    return _exact(s, d, ["exact", "phonetic", "regex"], None)


@query("c1_corrected")
def _(s, d):
    """Both tiers over all texts: the text, the log's length and the changes of each tier."""
    correct = R.Corrector(R.ordered_rules(_entries(s, d), ["exact", "regex", "phonetic"]))
    t = texts(s, d).where("hypothesis is not null")
    x = D.corrected_in_full(t, correct, _vocabulary(s, d), _entries(s, d), ["result_id"], "hypothesis")
    return x.select("result_id", "text", F.size("logs").alias("changes"), "tier1", "tier2", "pending")


@query("ag21_totals")
def _(s, d):
    """Of each model's texts: how many were changed, and the changes of each tier."""
    x = QUERIES["c1_corrected"](s, d).join(texts(s, d).select("result_id", "model_key", "hypothesis"), "result_id")
    return x.groupBy("model_key").agg(F.count("*").alias("texts"), F.count_if(F.col("text") != F.col("hypothesis")).alias("corrected"), F.sum("tier1").alias("tier1"), F.sum("tier2").alias("tier2"), F.sum("pending").alias("pending"))


_PATTERNS = f"""WITH {SEGMENTS_SQL}, rl AS (SELECT list(struct_pack(p := pattern, c := correct, text := '') ORDER BY id) AS rules FROM medical_dict_entries WHERE enabled AND strategy = 'regex' AND pattern <> '' AND wrong <> '' AND correct IS NOT NULL)
SELECT file_id, seq, CASE WHEN rules IS NULL THEN text ELSE list_reduce(rules, lambda acc, r: struct_pack(p := r.p, c := r.c, text := regexp_replace(acc.text, r.p, r.c, 'g')), struct_pack(p := '', c := '', text := text)).text END AS text FROM seg, rl WHERE text IS NOT NULL"""


@query("c4_regex_rules", _PATTERNS)
def _(s, d):
    r = sorted(R.ordered_rules(_entries(s, d), ["regex"]), key=lambda x: x["id"])
    return _said(s, d).select("file_id", "seq", R.patterns(F.col("text"), r).alias("text"))


@query("c5_phonetic_rules")
def _(s, d):
    correct = R.Corrector(R.ordered_rules(_entries(s, d), ["phonetic"]), ("phonetic",), clean=False)
    x = texts(s, d).where("hypothesis is not null").select("result_id", R.corrected(F.col("hypothesis"), correct).alias("x"))
    return x.select("result_id", "x.text", F.size("x.logs").alias("changes"))


_PLAIN = "list(struct_pack(w := wrong, c := correct, text := '', n := 0::BIGINT) ORDER BY id) AS rules FROM medical_dict_entries WHERE wrong <> '' AND correct IS NOT NULL"


@query("c7_plain_replacements", f"""WITH {TEXTS_SQL}, rl AS (SELECT {_PLAIN}), f AS (SELECT result_id, list_reduce(rules, lambda acc, r: struct_pack(w := r.w, c := r.c, text := replace(acc.text, r.w, r.c), n := acc.n + CASE WHEN contains(acc.text, r.w) THEN 1 ELSE 0 END), struct_pack(w := '', c := '', text := hypothesis, n := 0::BIGINT)) AS f FROM texts, rl WHERE hypothesis IS NOT NULL)
SELECT result_id, f.text AS text, CAST(f.n AS INTEGER) AS applied FROM f""")
def _(s, d):
    pairs = [(r.wrong, r.correct) for r in _entries(s, d).where("wrong <> '' and correct is not null").select("id", "wrong", "correct").orderBy("id").take(R.MOST_RULES)]
    x = texts(s, d).where("hypothesis is not null").select("result_id", R.replaced(F.col("hypothesis"), pairs).alias("x"))
    return x.select("result_id", "x.text", "x.applied")


@query("c13_rule_matches", f"WITH {TEXTS_SQL} SELECT result_id, (SELECT count(*) FROM medical_dict_entries e WHERE e.enabled AND e.wrong <> '' AND contains(hypothesis, e.wrong) AND (len(e.context_hint) = 0 OR e.context_hint IS NULL OR len(list_filter(e.context_hint, lambda h: contains(lower(hypothesis), lower(h)))) > 0)) AS rules FROM texts WHERE hypothesis IS NOT NULL")
def _(s, d):
    return R.matches(texts(s, d).select("result_id", F.col("hypothesis").alias("text")), _entries(s, d), ["result_id"])


_X = "regexp_replace(coalesce({0}, ''), '^ +| +$', '', 'g')"
_CHARS = lambda c: f"list_distinct(list_filter(string_split(regexp_replace({c}, '\\s', '', 'g'), ''), lambda z: z <> ''))"
_JACCARD = f"CASE WHEN len({_CHARS('o')}) = 0 OR len({_CHARS('t')}) = 0 THEN 0.0 ELSE len(list_intersect({_CHARS('o')}, {_CHARS('t')})) / (len({_CHARS('o')}) + len({_CHARS('t')}) - len(list_intersect({_CHARS('o')}, {_CHARS('t')}))) END"


@query("m18_hallucinated", f"""WITH j AS (SELECT run_id, type, min(hypothesis) AS o FROM jangmin_result_no_prompt GROUP BY run_id, type), z AS (SELECT result_id, {_X.format('hypothesis')} AS t, {_X.format('j.o')} AS o, -cer / 100 AS logprob, ratio AS silence FROM seastar105_result_no_prompt s LEFT JOIN j USING (run_id, type)),
 y AS (SELECT *, list_filter(list_transform(string_split(t, ','), lambda p: trim(p, ' ')), lambda p: p <> '') AS parts, {_JACCARD} AS alike FROM z)
SELECT result_id, length(t) < 3 OR {' OR '.join(f"contains(t, '{b}')" for b in D.BANNED)} OR coalesce(logprob < -0.9, false) OR (coalesce(silence > 0.5, false) AND length(t) < 50) OR (len(parts) >= 3 AND length(t) <= 48 AND len(list_filter(parts, lambda p: length(p) NOT BETWEEN 2 AND 14)) = 0 AND (o = '' OR alike < 0.2)) OR (length(o) >= 6 AND alike < 0.06 AND length(t) >= 8) AS hallucinated FROM y""")
def _(s, d):
    """One model's text beside the other's for the same run and type; rate and ratio stand for probability and silence."""
    o = table(s, d, "jangmin_result_no_prompt").groupBy("run_id", "type").agg(F.min("hypothesis").alias("o"))
    x = table(s, d, "seastar105_result_no_prompt").join(o, ["run_id", "type"], "left")
    return x.select("result_id", D.looks_hallucinated(F.col("hypothesis"), F.col("o"), -F.col("cer") / 100, F.col("ratio")).alias("hallucinated"))


joined(QUERIES, ORACLES, "c2_exact_rules", "applied")
joined(QUERIES, ORACLES, "c3_hints_near", "applied")
joined(QUERIES, ORACLES, "c6_hints_anywhere", "applied")

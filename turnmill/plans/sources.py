"""Queries of sources, signals and arrival windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.plans import exploded
from turnmill.functions import audio as A
from turnmill.sources import sinks
from turnmill.sources import transcripts as X
from turnmill.streaming import segments as stream
from turnmill.session import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_ARRAY = """d AS (SELECT doc_id, text, CASE WHEN contains(text, ']') AND regexp_matches(text, '^\\s*\\[') THEN left(text, length(text) - strpos(reverse(text), ']') + 1) END AS a FROM documents),
 j AS (SELECT doc_id, text, CASE WHEN json_valid(a) THEN from_json(a, '[{"role":"VARCHAR","index":"INTEGER","content":"VARCHAR"}]') END AS t FROM d)"""


@query("src1_transcript_turns", f"WITH {_ARRAY}, u AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS x FROM j WHERE t IS NOT NULL) SELECT doc_id, pos, x.role AS role, x.index AS index, x.content AS content FROM u")
def _(s, d):
    return X.rows(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("src2_transcript_texts", f"WITH {_ARRAY} SELECT doc_id, array_to_string(list_filter(list_transform(t, lambda x: trim(x.content, ' ')), lambda c: c <> ''), ' ') AS text FROM j WHERE t IS NOT NULL")
def _(s, d):
    return X.joined(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("src13_corpus", f"WITH {_ARRAY}, c AS (SELECT doc_id, unnest(list_transform(t, lambda x: x.content)) AS text FROM j WHERE t IS NOT NULL UNION ALL SELECT doc_id, text FROM j WHERE t IS NULL) SELECT doc_id, text FROM c WHERE trim(text, ' ') <> ''")
def _(s, d):
    return X.corpus(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


# signals: the embeddings stand for samples, 4 or 16 of them for a frame -------------------------------------------

_SQUARES = "list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_ENERGIES = f"list_sort(list_transform(range(0, len(embedding) // 4), lambda i: greatest({_SQUARES.format('list_slice(embedding, i * 4 + 1, i * 4 + 4)')} / 4, 1e-10)))"
_SNR = f"""e AS (SELECT vec_id, {_ENERGIES} AS e, len(embedding) // 4 AS n FROM embeddings),
 l AS (SELECT vec_id, n, list_avg(list_slice(e, 1, greatest(n // 3, 1))) AS low, list_avg(list_slice(e, greatest(2 * n // 3, 1) + 1, n)) AS high FROM e),
 snr AS (SELECT vec_id, CASE WHEN n IS NULL OR n < 10 THEN 30.0 WHEN low < 1e-10 THEN 40.0 ELSE round(10 * log10(high / low), 1) END AS snr FROM l),
 q AS (SELECT vec_id, snr, CASE WHEN snr >= 25 THEN 'excellent' WHEN snr >= 15 THEN 'good' WHEN snr >= 8 THEN 'fair' ELSE 'poor' END AS quality FROM snr)"""
_STRENGTH = "CASE quality WHEN 'excellent' THEN 'none' WHEN 'good' THEN 'light' WHEN 'fair' THEN 'medium' ELSE 'strong' END"


def _rounded(samples):
    return F.transform(samples, lambda x: F.round(x, 6))


@query("a1_signal_to_noise", f"WITH {_SNR} SELECT vec_id, CAST(snr AS DOUBLE) AS snr FROM q")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", A.signal_to_noise(F.col("embedding"), 4).alias("snr"))


@query("a2_strength", f"WITH {_SNR} SELECT vec_id, quality, {_STRENGTH} AS strength FROM q")
def _(s, d):
    grade = A.quality(A.signal_to_noise(F.col("embedding"), 4))
    return table(s, d, "embeddings").select("vec_id", grade.alias("quality"), A.strength(grade).alias("strength"))


_LOUD = f"list_transform(embedding, lambda x: greatest(least(CAST(x AS DOUBLE) * CASE WHEN sqrt({_SQUARES.format('embedding')} / len(embedding)) >= 1e-10 THEN power(10, -16.0 / 20) / sqrt({_SQUARES.format('embedding')} / len(embedding)) ELSE 1.0 END, 1.0), -1.0))"


@query("a3_loudness", f"SELECT vec_id, list_transform({_LOUD}, lambda x: round(x, 6)) AS samples FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", _rounded(A.loudness_normalised(F.col("embedding"))).alias("samples"))


@query("a4_peak", """WITH p AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS peak FROM embeddings)
SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(greatest(least(CAST(x AS DOUBLE) * CASE WHEN peak > 1e-8 THEN power(10, -3.0 / 20) / peak ELSE 1.0 END, 1.0), -1.0) * 32767) AS INTEGER)) AS samples FROM p""")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", A.peak_normalised(F.col("embedding")).alias("samples"))


@query("a5_compressed", f"""WITH f AS (SELECT vec_id, list_transform(range(0, CAST(ceil(len(embedding) / 16.0) AS BIGINT)), lambda i: list_slice(embedding, i * 16 + 1, i * 16 + 16)) AS frames FROM embeddings),
 r AS (SELECT vec_id, list_transform(frames, lambda f: struct_pack(f := f, rms := sqrt({_SQUARES.format('f')} / len(f)))) AS frames FROM f),
 g AS (SELECT vec_id, list_transform(frames, lambda z: struct_pack(f := z.f, gain := CASE WHEN z.rms >= 1e-6 AND least(0.08 / z.rms, 6.0) > 1.2 THEN 1 + (least(0.08 / z.rms, 6.0) - 1) * 0.7 ELSE 1.0 END)) AS frames FROM r)
SELECT vec_id, flatten(list_transform(frames, lambda z: list_transform(z.f, lambda x: round(CAST(x AS DOUBLE) * z.gain, 6)))) AS samples FROM g""")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", _rounded(A.compressed(F.col("embedding"), 16)).alias("samples"))


@query("a7_cut", "SELECT vec_id, list_slice(embedding, CAST(floor(greatest(1.0 - 0.5, 0) * 16) AS BIGINT) + 1, CAST(floor(least(2.0 + 0.5, len(embedding) / 16.0) * 16) AS BIGINT)) AS samples FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", A.cut(F.col("embedding"), 16, F.lit(1.0), F.lit(2.0)).alias("samples"))


@query("a9_enhanced", f"WITH {_SNR} SELECT vec_id, quality, {_STRENGTH} AS strength, quality <> 'excellent' AS enhanced, list_transform(CASE WHEN quality <> 'excellent' THEN {_LOUD} ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END, lambda x: round(x, 6)) AS samples FROM q JOIN embeddings USING (vec_id)")
def _(s, d):
    x = table(s, d, "embeddings").select("vec_id", A.enhanced(F.col("embedding"), 4).alias("x"))
    return x.select("vec_id", "x.quality", "x.strength", "x.enhanced", _rounded(F.col("x.samples")).alias("samples"))


@query("snk7_manifest", "SELECT file_id, variation, file_id || '_' || variation AS output FROM recordings, (VALUES ('slow'), ('fast'), ('noise')) v(variation)")
def _(s, d):
    return sinks.augmentation_manifest(table(s, d, "recordings").select("file_id"), ["slow", "fast", "noise"])


@query("st_sessions", """WITH o AS (SELECT file_id, received_at, CASE WHEN received_at - lag(received_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM transcribe_segments WINDOW w AS (PARTITION BY file_id ORDER BY received_at)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY received_at ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT file_id, min(received_at) AS session_start, max(received_at) + INTERVAL 30 MINUTE AS session_end, count(*) AS segments FROM i GROUP BY file_id, k""")
def _(s, d):
    return stream.sessions(table(s, d, "transcribe_segments"))


@query("st_windows", "SELECT time_bucket(INTERVAL 30 MINUTE, received_at) - INTERVAL 30 MINUTE * k AS window_start, count(*) AS segments FROM transcribe_segments, (VALUES (0), (1)) v(k) GROUP BY 1")
def _(s, d):
    return stream.windows(table(s, d, "transcribe_segments"))


exploded(QUERIES, ORACLES, "a3_loudness")
exploded(QUERIES, ORACLES, "a4_peak")
exploded(QUERIES, ORACLES, "a5_compressed")
exploded(QUERIES, ORACLES, "a7_cut")
exploded(QUERIES, ORACLES, "a9_enhanced")

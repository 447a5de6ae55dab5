"""WAV files: duration from the header, samples as floats, slices and writing."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(content: bytes | None) -> tuple[int, np.ndarray] | None:
    """(sample rate, mono samples within -1 and 1) of 16 or 32 bit PCM; None for anything else."""
    if not content:
        return None
    try:
        with wave.open(io.BytesIO(content)) as w:
            kind = {2: np.int16, 4: np.int32}.get(w.getsampwidth())
            if kind is None:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float32) / float(np.iinfo(kind).max + 1)
            return w.getframerate(), x.reshape(-1, w.getnchannels()).mean(1)
    except (wave.Error, EOFError):
        return None


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16 bit mono WAV; samples are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype(np.int16).tobytes())
    return out.getvalue()


def durations(content: Column) -> Column:
    """Seconds by the header; null if it is no WAV."""

    @F.pandas_udf("double")
    def seconds(c: pd.Series) -> pd.Series:
        def one(b):
            try:
                with wave.open(io.BytesIO(b)) as w:
                    return w.getnframes() / w.getframerate()
            except (wave.Error, EOFError, TypeError, ZeroDivisionError):
                return None

        return c.map(one).astype("float64")

    return seconds(content)


def samples(content: Column) -> Column:
    """struct(sample_rate, samples), null if it can't be read."""

    @F.pandas_udf("sample_rate int, samples array<float>")
    def read(c: pd.Series) -> pd.DataFrame:
        got = [decode(b) for b in c]
        return pd.DataFrame({"sample_rate": [g and g[0] for g in got], "samples": [g and g[1] for g in got]})

    return read(content)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the WAV files below the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def padded_slice(values: Column, rate: int, start: Column, end: Column, pad: float = 0.5) -> Column:
    """The samples from ``pad`` seconds before the start to ``pad`` after the end, within the signal."""
    lo = F.greatest(F.floor((start - pad) * rate), F.lit(0)).cast("int")
    hi = F.least(F.ceil((end + pad) * rate), F.size(values)).cast("int")
    return F.slice(values, lo + 1, F.greatest(hi - lo, F.lit(0)))


def write_wavs(df: DataFrame, folder: str, rate: int) -> DataFrame:
    """Writes (name, samples) as WAV files of a shared folder, one task writing many; gives (name, bytes) when it is run."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                data = encode(np.asarray(x.as_py() or [], np.float64), rate)
                with fs.open_output_stream(f"{root.rstrip('/')}/{name}.wav") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return df.select(F.col("name").cast("string"), F.col("samples").cast("array<double>")).mapInArrow(put, "name string, bytes bigint")

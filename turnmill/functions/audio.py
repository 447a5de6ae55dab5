"""Signal expressions on arrays of samples, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def frame_energies(samples: Column, size: int) -> Column:
    """Mean square of each whole frame, at least 1e-10."""
    n = F.floor(F.size(samples) / size).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * size + 1, F.lit(size)))
    energy = lambda f: F.greatest(_sum(F.transform(f, lambda x: x.cast("double") * x.cast("double"))) / size, F.lit(1e-10))
    return F.when(n > 0, F.transform(frames, energy))


def signal_to_noise(samples: Column, size: int, fewest: int = 10) -> Column:
    """Decibels between the mean of the upper and of the lower third of the frames' energies; 30 for too few frames, 40 for silence.

    Thirds are floored: the lower one ends, and the upper one begins, at the floor of one and two thirds of the frames.
    """
    e = F.array_sort(frame_energies(samples, size))
    n = F.size(e)
    lower, upper = F.greatest(F.floor(n / 3), F.lit(1)).cast("int"), F.greatest(F.floor(2 * n / 3), F.lit(1)).cast("int")
    low = _sum(F.slice(e, F.lit(1), lower)) / lower
    high = _sum(F.slice(e, upper + 1, n - upper)) / (n - upper)
    level = F.when(low < 1e-10, 40.0).otherwise(F.round(10 * F.log10(high / low), 1))
    return F.when(e.isNull() | (n < fewest), 30.0).otherwise(level)


def quality(snr: Column) -> Column:
    """excellent, good, fair or poor from 25, 15 and 8 decibels."""
    return F.when(snr >= 25, "excellent").when(snr >= 15, "good").when(snr >= 8, "fair").when(snr.isNotNull(), "poor")


def strength(grade: Column) -> Column:
    """How strongly a signal of that quality is treated."""
    return F.when(grade == "excellent", "none").when(grade == "good", "light").when(grade == "fair", "medium").when(grade == "poor", "strong")


def _rms(samples: Column) -> Column:
    return F.sqrt(_sum(F.transform(samples, lambda x: x.cast("double") * x.cast("double"))) / F.size(samples))


def _clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def loudness_normalised(samples: Column, decibels: float = -16.0) -> Column:
    """Scaled to the root mean square of the level, clipped to -1 and 1; silence stays."""
    rms = _rms(samples)
    gain = F.when(rms >= 1e-10, F.lit(10 ** (decibels / 20)) / rms).otherwise(1.0)
    return F.transform(samples, lambda x: _clipped(x.cast("double") * gain))


def peak_normalised(samples: Column, decibels: float = -3.0) -> Column:
    """Scaled so that the largest sample has the level, as 16 bit numbers, cut towards zero."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    gain = F.when(peak > 1e-8, F.lit(10 ** (decibels / 20)) / peak).otherwise(1.0)
    return F.transform(samples, lambda x: (_clipped(x.cast("double") * gain) * 32767).cast("int"))


def compressed(samples: Column, size: int, most: float = 6.0, share: float = 0.7, above: float = 1.2, level: float = 0.08) -> Column:
    """Quiet frames raised towards the level: gain up to ``most``, applied by ``share`` where it is ``above``; silent frames stay.

    What is left after the last whole frame is a frame of its own.
    """
    n = F.ceil(F.size(samples) / size).cast("int")

    def frame(i: Column) -> Column:
        f = F.slice(samples, i * size + 1, F.lit(size))
        rms = _rms(f)
        gain = F.least(F.lit(level) / rms, F.lit(most))
        used = F.when((rms >= 1e-6) & (gain > above), 1 + (gain - 1) * share).otherwise(1.0)
        return F.transform(f, lambda x: x.cast("double") * used)

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), frame))).otherwise(F.transform(samples, lambda x: x.cast("double")))


def cut(samples: Column, rate: int, start: Column, end: Column, padding: float = 0.5) -> Column:
    """The samples from ``start`` to ``end`` seconds with ``padding`` on either side, within the signal."""
    total = F.size(samples) / F.lit(rate)
    first = F.floor(F.greatest(start - padding, F.lit(0.0)) * rate).cast("int")
    last = F.floor(F.least(end + padding, total) * rate).cast("int")
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))


def enhanced(samples: Column, size: int, filters: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """struct(quality, strength, enhanced, samples): an excellent signal stays, any other is filtered by its strength and brought to loudness.

    ``filters`` gives the filter of each strength; without one the signal is only brought to loudness.
    """
    grade = quality(signal_to_noise(samples, size))
    out = F.transform(samples, lambda x: x.cast("double"))
    done = loudness_normalised(samples)
    for name, f in (filters or {}).items():
        done = F.when(strength(grade) == name, loudness_normalised(f(samples))).otherwise(done)
    touched = F.coalesce(grade != "excellent", F.lit(False))
    return F.struct(grade.alias("quality"), strength(grade).alias("strength"), touched.alias("enhanced"), F.when(touched, done).otherwise(out).alias("samples"))

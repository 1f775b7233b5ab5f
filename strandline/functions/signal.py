"""Measures over arrays of 16-bit samples.  Samples are widened before they are squared or made absolute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_DBFS = -120.0


def dbfs(rms: Column) -> Column:
    return F.when(rms.isNotNull(), F.log10(F.greatest(rms, F.lit(1.0)) / 32768) * 20)


def rms(samples: Column) -> Column:
    """Root mean square; null for no samples."""
    power = F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    return F.sqrt(F.try_divide(power.cast("double"), F.size(samples)))


def clip(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples between two times in seconds."""
    left = F.greatest(F.lit(0), F.rint(start * rate).cast("int"))
    right = F.least(F.size(samples), F.rint(end * rate).cast("int"))
    return F.slice(samples, left + 1, F.greatest(right - left, F.lit(0)))


def level(samples: Column) -> Column:
    return F.coalesce(dbfs(rms(samples)), F.lit(EMPTY_DBFS))


def interval_levels(samples: Column, rate: Column, intervals: Column) -> Column:
    """Loudness of each struct<start, end> of an array, in one pass over the row."""
    return F.transform(intervals, lambda i: level(clip(samples, rate, i["start"], i["end"])))


def clipping_ratio(samples: Column, top: int = 32700) -> Column:
    loud = F.size(F.filter(samples, lambda x: F.abs(x.cast("int")) >= top))
    return F.coalesce(F.try_divide(loud.cast("double"), F.size(samples)), F.lit(0.0))


def frames(samples: Column, rate: Column, seconds: float = 0.1) -> Column:
    """array<struct<start, end, dbfs>> of frames of a fixed length; the last may be shorter."""
    size, n = F.greatest(F.lit(1), F.rint(rate * seconds).cast("int")), F.size(samples)
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: k * size)).otherwise(F.array().cast("array<int>"))

    def one(at: Column) -> Column:
        frame = F.slice(samples, at + 1, size)
        return F.struct((at / rate).alias("start"), (F.least(n, at + F.size(frame)) / rate).alias("end"), dbfs(rms(frame)).alias("dbfs"))

    return F.transform(starts, one)

"""Overlapping windows that own their middles, so that each record is kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_windows(durations: DataFrame, duration: str = "duration", size: float = 30.0, overlap: float = 2.0, close_gaps: bool = False) -> DataFrame:
    """One row for each window of each row: window_no, start, end, owned_start, owned_end.

    Windows of ``size`` begin every ``size - overlap`` seconds while they begin before the end.  An inner
    edge gives half the overlap to the neighbour.  A last window shorter than the overlap leaves a hole in
    the ownership; ``close_gaps`` lets each window own up to where the next one begins to.
    """
    d = F.col(duration).cast("double")
    spread = durations.filter(d > 0).select("*", F.explode(F.sequence(F.lit(0), _last(d, size, overlap))).alias("window_no"))
    return spread.select("*", *_window_bounds(F.col("window_no"), d, size, overlap, close_gaps))


def decode_window_array(duration: Column, size: float = 30.0, overlap: float = 2.0) -> Column:
    """The windows of one duration as an array of structs, as ``decode_windows`` lists them in rows."""
    d = duration.cast("double")
    one = lambda k: F.struct(k.alias("window_no"), *_window_bounds(k, d, size, overlap))
    return F.when(d > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), _last(d, size, overlap))), one))


def _last(d: Column, size: float, overlap: float) -> Column:
    return (F.ceil(d / float(size - overlap)) - 1).cast("int")


def _window_bounds(number: Column, d: Column, size: float, overlap: float, close_gaps: bool = False) -> list[Column]:
    step = float(size - overlap)
    start, end = number * step, F.least(d, number * step + float(size))
    owned_start = F.when(number == 0, start).otherwise(start + overlap / 2)
    to_next = F.least(d, start + step + overlap / 2) if close_gaps else end - overlap / 2
    return [
        start.alias("start"), end.alias("end"),
        (F.least(owned_start, d) if close_gaps else owned_start).alias("owned_start"),
        F.when(number == _last(d, size, overlap), end).otherwise(to_next).alias("owned_end"),
    ]


def source_chunks(durations: DataFrame, duration: str = "duration", size: float = 300.0, overlap: float = 1.0) -> DataFrame:
    """One row for each chunk: chunk_no, decode_start, decode_duration, owned_start, owned_end (relative to the decode start)."""
    d = F.col(duration).cast("double")
    count = F.greatest(F.lit(1), F.ceil(d / float(size)).cast("int"))
    spread = durations.filter(d.isNotNull()).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    return spread.select("*", *chunk_bounds(F.col("chunk_no"), d, size, overlap))


def seen_by_chunks(records: DataFrame, start: str = "start", duration: str = "duration", size: float = 300.0, overlap: float = 1.0) -> DataFrame:
    """Each record, which has its whole's duration, with each chunk whose decoded range may hold its start: ``source_chunks``' columns.

    Numbers and bounds follow from the times, so the chunks of long wholes with few records are never listed.
    """
    at, d = F.col(start), F.col(duration).cast("double")
    near = F.array_distinct(F.array(*(F.floor((at + x) / float(size)) for x in (-float(overlap), 0.0, float(overlap)))).cast("array<int>"))
    count = F.greatest(F.lit(1), F.ceil(d / float(size)).cast("int"))
    met = records.filter(d.isNotNull()).select("*", F.explode(F.filter(near, lambda k: (k >= 0) & (k < count))).alias("chunk_no"))
    return met.select("*", *chunk_bounds(F.col("chunk_no"), d, size, overlap))


def chunk_bounds(number: Column, duration: Column, size: float = 300.0, overlap: float = 1.0) -> list[Column]:
    begin = number * float(size)
    finish = F.least(duration, begin + float(size))
    lo, hi = F.greatest(F.lit(0.0), begin - float(overlap)), F.least(duration, finish + float(overlap))
    return [lo.alias("decode_start"), (hi - lo).alias("decode_duration"), (begin - lo).alias("owned_start"), (finish - lo).alias("owned_end")]


def owned(records: DataFrame, start: str = "start", end: str = "end", lo: str = "owned_start", hi: str = "owned_end") -> DataFrame:
    """Rows whose middle lies in the owned range, its end excluded."""
    middle = (F.col(start) + F.col(end)) / 2
    return records.filter((middle >= F.col(lo)) & (middle < F.col(hi)))


def shifted(records: DataFrame, offset: str = "decode_start", start: str = "start", end: str = "end") -> DataFrame:
    """Times relative to a chunk become times of the whole."""
    return records.withColumns({start: F.col(start) + F.col(offset), end: F.col(end) + F.col(offset)})

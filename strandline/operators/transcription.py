"""From samples to segments: windows go to a model, what it missed goes to two models again, the better is kept.

Chunks are rows of samples.  Everything but the models' calls and the loudness of what they heard is DataFrame
operators over the chunks' keys; a chunk's samples are made and reach Python once for its windows and loud
intervals, and once more if it has intervals to retry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..functions.workers import shared_dir, ship
from ..settings import Settings
from . import intervals, segments, sequences, windows
from .models import Transcriber

#: A fixed value: from this share of clipped samples on, retries are given repaired samples.
REPAIR_FROM = 0.0005
#: Rows that a worker gathers before it hands them on.
ROWS = 20_000
_FOUND = "seq long, start double, end double, text string, avg_logprob double, no_speech_prob double, rms double"


def _once(df: DataFrame) -> DataFrame:
    """Answers of a model, which is asked once: kept in the checkpoint folder, which all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _rows(found: Sequence[dict]) -> list[tuple]:
    """Segments as a model says them, with what is missing left null."""
    return [(_number(s.get("start")) or 0.0, _number(s.get("end")) or 0.0, str(s.get("text", "")), _number(s.get("avg_logprob")), _number(s.get("no_speech_prob"))) for s in found]


def specialist_retries(model: Transcriber, samples, clips: Sequence[tuple[float, float]]) -> list[list[dict]]:
    """The specialist's segments of each clip; RuntimeError if it answers for more or fewer clips than it was given."""
    if not clips:
        return []
    found = model.transcribe_specialist_batch(samples, clips)
    if not isinstance(found, list) or len(found) != len(clips):
        raise RuntimeError(f"the specialist answered for {len(found) if isinstance(found, list) else 'no'} clips instead of {len(clips)}")
    return found


class _Loudness:
    """What ``signal.rms`` over ``signal.clip`` and ``segments.activity`` say of one chunk, from running sums of squares."""

    def __init__(self, samples, rate: int):
        import numpy as np

        self.n, self.rate = len(samples), rate
        self.upto = np.zeros(self.n + 1, dtype="i8")
        np.cumsum(np.asarray(samples, dtype="i8") ** 2, out=self.upto[1:])

    def rms(self, start: float, end: float) -> float | None:
        left, right = max(0, round(start * self.rate)), min(self.n, round(end * self.rate))
        return math.sqrt(int(self.upto[right] - self.upto[left]) / (right - left)) if right > left else None

    def activity(self, threshold: float, seconds: float = 0.1, gap: float = 0.2, least: float = 0.2) -> list[tuple[float, float]]:
        import numpy as np

        size = max(1, round(self.rate * seconds))
        at = np.arange(0, self.n, size)
        to = np.minimum(self.n, at + size)
        rms = np.sqrt((self.upto[to] - self.upto[at]) / (to - at))
        loud = np.log10(np.maximum(rms, 1.0) / 32768) * 20 >= threshold
        start, end = at[loud] / self.rate, to[loud] / self.rate
        if not len(start):
            return []
        opens = np.append(True, start[1:] - end[:-1] > gap)
        start, end = start[opens], end[np.append(opens[1:], True)]
        return [(a, b) for a, b in zip(start.tolist(), end.tolist()) if b - a >= least]


def _called(rows: DataFrame, part: Sequence[str], extra: str, call: Callable) -> DataFrame:
    """The rows that ``call(model row)`` gives for each row, with its keys; samples come as an array of numpy."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(extra)
    types = [to_arrow_type(f.dataType) for f in made.fields]
    schema, names = StructType([*(rows.schema[c] for c in part), *made.fields]), [*part, *made.names]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def value(batch, name: str, k: int):
            x = batch.column(name)[k]
            if name != "samples":
                return x.as_py()
            return np.zeros(0, dtype="i2") if x.values is None else x.values.to_numpy(zero_copy_only=False)

        def table(batch, at: list, found: list):
            columns = zip(*found) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int32())) for c in part), *(pa.array(x, t) for x, t in zip(columns, types))], names=names)

        for batch in batches:
            at, found = [], []
            for k in range(batch.num_rows):
                new = list(call(SimpleNamespace(**{c: value(batch, c, k) for c in batch.schema.names if c not in part})))
                found += new
                at += [k] * len(new)
                if len(found) >= ROWS:
                    yield table(batch, at, found)
                    at, found = [], []
            yield table(batch, at, found)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def heard(chunks: DataFrame, factory: Callable[[], Transcriber], part: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """(part, duration, rate, samples) -> in one pass over the samples: what a model hears in each window, kept where the
    window owns its middle, in the order heard (seq); and, with ``loud``, the chunk's loud intervals.  Both with rms."""
    w = windows.decode_window_array(F.col("duration"), size=settings.decode_window_seconds, overlap=settings.window_overlap_seconds)
    threshold = settings.rescue_activity_dbfs

    def call(row) -> Iterator:
        model, seq, loudness = factory(), 0, _Loudness(row.samples, row.rate)
        for x in row.windows or []:
            for s in _rows(model.transcribe(row.samples, x["start"], x["end"])):
                yield seq, *s, loudness.rms(s[0], s[1]), x["owned_start"], x["owned_end"], False
                seq += 1
        for a, b in loudness.activity(threshold):
            yield None, a, b, None, None, None, None, a, math.inf, True

    every = _called(chunks.select(*part, "rate", "samples", w.alias("windows")), part, f"{_FOUND}, owned_start double, owned_end double, loud boolean", call)
    return windows.owned(every).drop("owned_start", "owned_end")


def window_segments(chunks: DataFrame, factory: Callable[[], Transcriber], part: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """What a model hears in each window of each chunk, kept where the window owns its middle; seq is the order heard."""
    return heard(chunks, factory, part, settings).filter("not loud").drop("loud", "rms")


def retries(chunks: DataFrame, spans: DataFrame, factory: Callable[[], Transcriber], part: Sequence[str], settings: Settings = Settings(), repair: Callable | None = None) -> DataFrame:
    """(part, interval_no, start, end) -> what either model hears there at a second try, with side, interval_no and the rms of both.

    ``repair`` is the boundary to a program that mends clipped samples: it returns samples, or None if it failed.
    """
    asked = spans.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("interval_no", "start", "end"))).alias("spans"))
    rows = chunks.select(*part, "rate", "samples").join(asked, list(part))
    both = settings.specialist_model is not None

    def clipped(samples, top: int = 32700) -> float:
        import numpy as np

        return float(np.mean(np.abs(np.asarray(samples, dtype="i4")) >= top)) if len(samples) else 0.0

    def call(row) -> Iterator:
        model, samples, loudness = factory(), row.samples, _Loudness(row.samples, row.rate)
        if repair is not None and clipped(samples) >= REPAIR_FROM:
            mended = repair(samples)
            samples = samples if mended is None else mended
        clips = [(x["start"], x["end"]) for x in row.spans]
        first = [model.transcribe(samples, a, b, rescue=True) for a, b in clips]
        second = specialist_retries(model, samples, clips) if both else [[] for _ in clips]
        for x, *sides in zip(row.spans, first, second):
            whole = loudness.rms(x["start"], x["end"])
            for side, found in zip(("primary", "specialist"), sides):
                for seq, s in enumerate(_rows(found)):
                    yield seq, *s, loudness.rms(s[0], s[1]), x["interval_no"], side, whole

    return _called(rows, part, f"{_FOUND}, interval_no int, side string, span_rms double", call)


def transcribe_chunks(chunks: DataFrame, factory: Callable[[], Transcriber], part: Sequence[str] = ("media_id", "chunk_no"), settings: Settings = Settings(), repair: Callable | None = None, **how) -> DataFrame:
    """(part, duration, rate, samples) -> part, order, start, end, text, avg_logprob: a chunk's segments in order.

    Windows, ownership, the foreground filter, loud intervals, those to be retried, both models' retries, the
    choice between them, the foreground again, the merge, and bursts dropped.  ``order`` is that of the
    windows where nothing was to be retried, else that of times.  ``how`` goes to the rules on texts.
    """
    part = list(part)
    found = heard(chunks, factory, part, settings).withColumn("dbfs", signal.dbfs(F.col("rms")))
    found = _once(found.filter(F.col("loud") | segments.is_foreground(settings)))
    first, loud = found.filter("not loud").drop("loud"), found.filter("loud")
    spans = _once(intervals.rescue_intervals(loud, first, part, chunks.select(*part, "duration"), flag=settings.rescue_flag_logprob))
    again = _once(segments.valid_rescue(retries(chunks, spans, factory, part, settings, repair), settings, **how))
    each = [*part, "interval_no"]
    levels = again.groupBy(*each).agg(F.coalesce(signal.dbfs(F.max("span_rms")), F.lit(signal.EMPTY_DBFS)).alias("dbfs"))
    side = lambda name: again.filter(F.col("side") == name).drop("side")
    taken = segments.chosen(side("primary"), side("specialist"), levels, each, settings)
    usable = again.join(taken.select(*each, "chosen"), each).filter("side = chosen")
    recovered = usable.withColumn("dbfs", signal.dbfs(F.col("rms"))).filter(segments.is_foreground(settings))
    recovered = recovered.withColumn("seq", F.col("interval_no") * F.lit(1 << 32) + F.col("seq"))  # interval by interval
    merged = intervals.rescue_merge(first, recovered, part, flag=settings.rescue_flag_logprob)
    tried = spans.select(*part).distinct().withColumn("_tried", F.lit(True))
    ordered = merged.join(tried, part, "left").withColumn("order", F.when(F.col("_tried"), F.col("order").cast("long")).otherwise(F.col("seq"))).drop("_tried", "seq")
    return sequences.drop_bursts(ordered, part, ["order"])


def assemble(found: DataFrame, bounds: DataFrame, settings: Settings = Settings(), media: str = "media_id", chunk: str = "chunk_no", **how) -> DataFrame:
    """Chunks' segments -> the medium's cues: each chunk keeps what it owns, becomes cues by itself, and all are numbered on.

    ``bounds``: media, chunk, decode_start, owned_start, owned_end, as ``windows.source_chunks`` has them.
    """
    mine = windows.shifted(windows.owned(found.join(bounds.select(media, chunk, "decode_start", "owned_start", "owned_end"), [media, chunk])))
    cues = segments.to_cues(mine, [media, chunk], ["order"], settings, **how)
    return sequences.renumber(cues.withColumnRenamed("idx", "_idx"), [media], [chunk, "_idx"]).drop("_idx")

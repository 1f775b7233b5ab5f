"""Schemas of the timed-record relations."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


CUE = _struct(media_id=_S, lang=_S, idx=_I, timing=_S, start_ms=_L, end_ms=_L, text=_S)
SEGMENT = _struct(media_id=_S, chunk_no=_I, seq=_I, start=_D, end=_D, text=_S, avg_logprob=_D, no_speech_prob=_D, extra=T.MapType(_S, _S))
INTERVAL = _struct(media_id=_S, interval_no=_I, start=_D, end=_D)
WINDOW = _struct(start=_D, end=_D, owned_start=_D, owned_end=_D)
PCM = _struct(media_id=_S, rate=_I, channels=_I, width=_I, samples=T.ArrayType(T.ShortType()))
MEDIA = _struct(path=_S, name=_S, length=_L, mtime_ns=_L, duration_ms=_L)
PROVENANCE = _struct(stage=_S, output_key=_S, fingerprint=_S)
GATE = _struct(kind=_S, fingerprint=_S, status=_S, media=_S, source_sha256=_S, target_sha256=_S)
EVENT = _struct(event=_S, timestamp=_S, message=_S)
REPORT = _struct(status=_S, name=_S, detail=_S)
MANIFEST = T.MapType(_S, T.MapType(_S, _struct(repo=_S, revision=_S, directory=_S, filename=_S)))

"""Sample arrays from WAV files and from a decoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PCM


def decode_wav(content: bytes) -> tuple[int, list[int]]:
    """Rate and samples of mono 16-bit WAV bytes; ValueError for other formats."""
    import io
    import wave

    import numpy as np

    with wave.open(io.BytesIO(content), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 2:
            raise ValueError("samples must be mono and 16 bits wide")
        return w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")


def wav_clip(path: str, start: float, duration: float) -> tuple[bytes, float, str]:
    """A decoder for ``decode_clips`` that needs no media program: part of a WAV file, as one."""
    import io
    import wave

    with wave.open(path, "rb") as w:
        rate = w.getframerate()
        first = min(w.getnframes(), round(start * rate))
        w.setpos(first)
        frames = w.readframes(round(duration * rate))
        held = len(frames) // (w.getsampwidth() * w.getnchannels())
        whole = io.BytesIO()
        with wave.open(whole, "wb") as out:
            out.setparams(w.getparams())
            out.writeframes(frames)
    return whole.getvalue(), held / rate, ""


def wav_seconds(path: str) -> float:
    import wave

    with wave.open(path, "rb") as w:
        return w.getnframes() / w.getframerate()


def from_bytes(files: DataFrame, content: str = "content", media: str = "media_id") -> DataFrame:
    """(media_id, content) -> media_id, rate, channels, width, samples."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            made = [decode_wav(c) for c in pdf["content"]]
            yield pd.DataFrame({"media_id": pdf["media_id"], "rate": [r for r, _ in made], "channels": 1, "width": 2, "samples": [s for _, s in made]})

    return files.select(F.col(media).alias("media_id"), F.col(content).alias("content")).mapInPandas(run, PCM)


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return from_bytes(files.select(F.element_at(F.split("path", "/"), -1).alias("media_id"), "content"))


def decode_clips(clips: DataFrame, decoder: Callable[[str, float, float], tuple[bytes, float, str]]) -> DataFrame:
    """(media_id, chunk_no, path, decode_start, decode_duration) -> the same with rate, samples, real_duration, warnings.

    ``decoder`` is the boundary to a media program: it returns WAV bytes, their duration and its warnings.
    """
    from pyspark.sql import types as T

    extra = [("rate", T.IntegerType()), ("samples", T.ArrayType(T.ShortType())), ("real_duration", T.DoubleType()), ("warnings", T.StringType())]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            made = [decoder(p, s, d) for p, s, d in zip(pdf["path"], pdf["decode_start"], pdf["decode_duration"])]
            wavs = [decode_wav(w) for w, _, _ in made]
            yield pdf.assign(rate=[r for r, _ in wavs], samples=[s for _, s in wavs], real_duration=[d for _, d, _ in made], warnings=[w for _, _, w in made])

    return clips.mapInPandas(run, T.StructType([*clips.schema.fields, *(T.StructField(n, t) for n, t in extra)]))

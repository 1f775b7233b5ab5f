"""From recognised segments to cues: filters on loudness, confidence and stock phrases, and the choice between two models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal, timecode
from ..functions import text as X
from ..settings import RESCUE_PHRASES, SILENCE_PHRASES, Settings
from . import sequences


def is_foreground(settings: Settings, minimum_dbfs: float | None = None) -> Column:
    """Whether a segment with dbfs is loud, or less so and the model was sure of it."""
    least = settings.foreground_min_dbfs if minimum_dbfs is None else minimum_dbfs
    sure = (timecode.logprob(F.col("avg_logprob")) >= settings.foreground_confident_logprob) & (timecode.no_speech_prob(F.col("no_speech_prob")) <= settings.foreground_confident_no_speech_prob)
    return F.col("dbfs").isNotNull() & ((F.col("dbfs") >= least) | ((F.col("dbfs") >= settings.foreground_confident_min_dbfs) & sure))


def foreground(segments: DataFrame, settings: Settings = Settings(), minimum_dbfs: float | None = None, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Loud segments, and quieter ones of which the model was sure; ``segments`` carry their medium's samples.  Adds dbfs."""
    window = signal.clip(F.col(samples), F.col(rate), F.coalesce("start", F.lit(0.0)), F.coalesce("end", F.lit(0.0)))
    return segments.withColumn("dbfs", signal.dbfs(signal.rms(window))).filter(is_foreground(settings, minimum_dbfs))


def activity(pcm: DataFrame, part: Sequence[str], threshold: float = -28.0) -> DataFrame:
    """(part, samples, rate) -> loud intervals of each medium, joined over gaps of up to 0.2 s."""
    from .intervals import merge_gaps

    loud = pcm.select(*part, F.explode(signal.frames(F.col("samples"), F.col("rate"))).alias("f")).filter(F.col("f.dbfs") >= threshold)
    return merge_gaps(loud.select(*part, "f.start", "f.end"), part)


def to_cues(segments: DataFrame, part: Sequence[str], order: Sequence[str], settings: Settings = Settings(), phrases: Sequence[str] = SILENCE_PHRASES, ratio: Column | None = None) -> DataFrame:
    """Filter segments and number what stays: stock phrases of 10 s and more, bad texts, empty spans, exact bursts go.

    Segments are dealt out by ``part`` first, so that rules on texts run in as many tasks as what follows.
    """
    segments = segments.repartition(*part)
    # A generator keeps the filters above the collapsed text, so it is made once for all of them.
    text = F.inline(F.array(F.struct(X.collapse(F.coalesce("text", F.lit(""))).alias("text"))))
    s = segments.select(*(c for c in segments.columns if c != "text"), text)
    s = s.withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("end", F.coalesce("end", "start"))
    s = s.filter(~(X.stock_phrase(F.col("text"), phrases) & (F.col("end") - F.col("start") >= 10)))
    s = s.filter("text != '' and end > start").filter(X.quality_error(F.col("text"), settings.script, ratio).isNull())
    s = sequences.renumber(sequences.drop_exact_bursts(s, part, order, dealt=True), part, order)
    return s.withColumn("timing", timecode.timing(F.col("start"), F.col("end")))


def valid_rescue(segments: DataFrame, settings: Settings = Settings(), phrases: Sequence[str] = RESCUE_PHRASES, ratio: Column | None = None) -> DataFrame:
    """Segments of a retry that may be used at all."""
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(text, f"[^{X.WORD}{X.KANA_CJK}]", "")
    ok = (X.strip(text) != "") & ~plain.isin(*phrases) & (timecode.logprob(F.col("avg_logprob")) >= settings.rescue_accept_logprob)
    return segments.filter(ok).filter(X.quality_error(text, settings.script, ratio).isNull())


def side(segments: DataFrame, part: Sequence[str], name: str) -> DataFrame:
    """One row for each interval of ``part``: the model's plain text, its least and whether there is any."""
    plain = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ""), f"[^{X.WORD}{X.KANA_CJK}]", "")
    return segments.groupBy(*part).agg(plain.alias(f"{name}_text"), F.min(timecode.logprob(F.col("avg_logprob"))).alias(f"{name}_least"))


def choose(primary: DataFrame, specialist: DataFrame, levels: DataFrame, part: Sequence[str], settings: Settings = Settings(), **how) -> DataFrame:
    """Which model's retry each interval of ``levels`` (part, dbfs) takes: part, agreement, chosen (primary, specialist or none).

    Texts that agree take the primary one; near agreement needs loud audio and sure models; a single text
    needs a sure model.  The three sides meet by the interval's key.
    """
    return chosen(valid_rescue(primary, settings, **how), valid_rescue(specialist, settings, **how), levels, part, settings)


def chosen(primary: DataFrame, specialist: DataFrame, levels: DataFrame, part: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """What ``choose`` takes, of segments that are known to be valid."""
    a, b = side(primary, part, "primary"), side(specialist, part, "specialist")
    t = levels.join(a, list(part), "left").join(b, list(part), "left")
    both = (F.coalesce("primary_text", F.lit("")) != "") & (F.coalesce("specialist_text", F.lit("")) != "")
    t = t.withColumn("agreement", X.similarity(F.when(both, F.col("primary_text")), F.when(both, F.col("specialist_text"))))
    near = (F.col("agreement") >= settings.rescue_conditional_agreement_threshold) & (F.col("dbfs") >= settings.rescue_activity_dbfs)
    sure = F.least("primary_least", "specialist_least") >= settings.foreground_confident_logprob
    alone = lambda c: F.col(c) >= settings.rescue_single_logprob
    taken = (
        F.when(F.coalesce(both & ((F.col("agreement") >= settings.rescue_agreement_threshold) | (near & sure)), F.lit(False)), "primary")
        .when(both, "none")
        .when(F.col("primary_least").isNotNull(), F.when(alone("primary_least"), "primary").otherwise("none"))
        .when(F.coalesce(alone("specialist_least"), F.lit(False)), "specialist")
        .otherwise("none")
    )
    return t.select(*part, "agreement", taken.alias("chosen"))

"""Runs, repetitions, neighbours and batches of ordered records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..settings import Script


def islands(rows: DataFrame, value: Column, part: Sequence[str], order: Sequence[str], dealt: bool = False) -> DataFrame:
    """``rows`` with _value, _island (numbered in order) and _run, the number of rows of the island.

    The value is computed after the one exchange, by the tasks that go on with it; ``dealt`` says that
    rows are dealt out by ``part`` already.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    r = (rows if dealt else rows.repartition(*part)).withColumn("_value", value)
    r = r.withColumn("_new", F.when(F.col("_value").eqNullSafe(F.lag("_value").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return r.withColumn("_run", F.count("*").over(Window.partitionBy(*part, "_island")))


def drop_bursts(rows: DataFrame, part: Sequence[str], order: Sequence[str], text: str = "text", least: int = 4, longest_root: int = 6) -> DataFrame:
    """Without runs of ``least`` or more rows that share a short repetition root; blank rows go first and split no run."""
    root = X.repetition_root(F.coalesce(F.col(text), F.lit("")))
    r = islands(rows.repartition(*part).withColumn("_root", root).filter(F.col("_root") != ""), F.col("_root"), part, order, dealt=True)
    return r.filter(~((F.col("_run") >= least) & (F.length("_root") <= longest_root))).select(*rows.columns)


def drop_exact_bursts(rows: DataFrame, part: Sequence[str], order: Sequence[str], text: str = "text", least: int = 4, dealt: bool = False) -> DataFrame:
    """Without runs of ``least`` or more rows of equal text, white space collapsed; ``dealt`` as for ``islands``."""
    return islands(rows, X.collapse(F.col(text)), part, order, dealt).filter(F.col("_run") < least).select(*rows.columns)


def renumber(rows: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def batches(rows: DataFrame, part: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with _rn (from 1) and batch_no (from 0)."""
    rn = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return rows.withColumn("_rn", rn).withColumn("batch_no", F.floor((F.col("_rn") - 1) / size).cast("int"))


def context_frames(rows: DataFrame, part: Sequence[str], order: Sequence[str], size: int, context: int, text: str = "text") -> DataFrame:
    """One row for each batch: its texts, and up to ``context`` texts before its first and after its last row."""
    w = Window.partitionBy(*part).orderBy(*order)
    r = batches(rows, part, order, size)
    r = r.withColumn("_before", F.collect_list(text).over(w.rowsBetween(-context, -1))).withColumn("_after", F.collect_list(text).over(w.rowsBetween(1, context)))
    return r.groupBy(*part, "batch_no").agg(
        F.min_by("_before", "_rn").alias("context_before"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(text).alias("t")))), lambda x: x["t"]).alias("texts"),
        F.max_by("_after", "_rn").alias("context_after"),
    )


def neighbours(rows: DataFrame, part: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """``rows`` with the texts before and after, with marks at both ends."""
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("previous", F.coalesce(F.lag(text).over(w), F.lit("(start)"))).withColumn("following", F.coalesce(F.lead(text).over(w), F.lit("(end)")))


def transcript_statistics(cues: DataFrame, part: Sequence[str], order: Sequence[str], text: str = "text", script: Script = Script(), ratio: Column | None = None) -> DataFrame:
    """One row a transcript: cues, longest_run, adjacent, dominant text and count, punctuation_only, bad cues and the first five of them."""
    w = Window.partitionBy(*part).orderBy(*order)
    cues = cues.repartition(*part)
    c = cues.select(*part, F.row_number().over(w).alias("_rn"), X.collapse(F.col(text)).alias("_t"), X.quality_error(F.col(text), script, ratio).alias("_bad"), F.col(order[0]).alias("_idx"))
    # The first five bad cues are known by a running count, so no more than five are gathered.
    c = c.withColumn("_nth", F.count("_bad").over(Window.partitionBy(*part).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)))
    c = islands(c, F.col("_t"), part, ["_rn"], dealt=True)
    per_text = c.groupBy(*part, "_t").agg(
        F.count("*").alias("_n"), F.min("_rn").alias("_first"), F.max("_run").alias("_longest"), F.countDistinct("_island").alias("_islands"),
        F.max(X.punctuation_only(F.col("_t"))).alias("_punct"),
        F.count("_bad").alias("_bads"),
        F.collect_list(F.when(F.col("_bad").isNotNull() & (F.col("_nth") <= 5), F.struct("_rn", "_idx", "_bad"))).alias("_some"),
    )
    lead = F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"))
    t = per_text.groupBy(*part).agg(
        F.sum("_n").alias("cues"), F.max("_longest").alias("longest_run"), F.sum(F.col("_n") - F.col("_islands")).alias("adjacent"),
        F.min_by("_t", lead).alias("dominant_text"), F.max("_n").alias("dominant_count"),
        F.sum(F.when(F.col("_punct"), F.col("_n")).otherwise(0)).alias("punctuation_only"), F.sum("_bads").alias("bad_cues"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.size("_some") > 0, F.col("_some"))))).alias("_first_bad"),
    )
    preview = F.array_join(F.transform("_first_bad", lambda b: F.concat(b["_idx"].cast("string"), F.lit(": "), b["_bad"])), ", ")
    return t.withColumn("bad_preview", preview).drop("_first_bad")


def transcript_errors(s: DataFrame) -> DataFrame:
    """Statistics -> the same with errors, an array of messages in a fixed order; empty for a sound transcript."""
    n = F.col("cues")
    tell = lambda test, *words: F.when(test, F.concat(*(w if isinstance(w, Column) else F.lit(w) for w in words)))
    text = lambda c: F.col(c).cast("string")
    messages = F.array_compact(
        F.array(
            tell(F.col("bad_cues") > 0, text("bad_cues"), " internally repetitive cue(s): ", F.col("bad_preview")),
            tell(F.col("longest_run") >= 25, "repetition loop: ", text("longest_run"), " consecutive identical cues"),
            tell((n >= 30) & (F.try_divide(F.col("adjacent").cast("double"), n - 1) > 0.20), "more than 20% adjacent cues are identical"),
            tell((F.col("dominant_count") >= 50) & (F.col("dominant_count") / n > 0.20), "one cue dominates transcript (", text("dominant_count"), "/", text("cues"), "): ", X.quoted(F.col("dominant_text"))),
            tell((n >= 100) & (F.col("punctuation_only") / n > 0.10), "more than 10% of cues contain punctuation only"),
        )
    )
    return s.withColumn("errors", messages)


def transcript_quality(cues: DataFrame, part: Sequence[str], order: Sequence[str], transcripts: DataFrame | None = None, **how) -> DataFrame:
    """The verdict of each transcript; those of ``transcripts`` without cues are told so."""
    found = transcript_errors(transcript_statistics(cues, part, order, **how))
    if transcripts is None:
        return found
    none = F.array(F.lit("transcript contains zero cues"))
    return transcripts.select(*part).distinct().join(found, list(part), "left").withColumn("errors", F.coalesce("errors", none)).fillna(0, ["cues"])

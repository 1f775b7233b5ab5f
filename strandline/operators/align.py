"""Two tracks side by side.

Both tracks are dealt out by medium once; numbering, pairing and verdicts then need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def pairs(source: DataFrame, target: DataFrame, media: str = "media_id", order: str = "idx") -> DataFrame:
    """Cues of both tracks by position, with nulls where a track ends early."""

    def side(d: DataFrame, number: int) -> DataFrame:
        return d.select(media, F.lit(number).alias("_side"), F.col(order).alias("_order"), F.struct("idx", "timing", "text").alias("_cue"))

    both = side(source, 0).unionByName(side(target, 1)).repartition(media)
    both = both.withColumn("pos", F.row_number().over(Window.partitionBy(media, "_side").orderBy("_order")))
    own = lambda number: F.max(F.when(F.col("_side") == number, F.col("_cue")))
    met = both.groupBy(media, "pos").agg(own(0).alias("_s"), own(1).alias("_t"))
    fields = [F.col(f"{s}.{f}").alias(f"{name}_{f}") for s, name in (("_s", "source"), ("_t", "target")) for f in ("idx", "timing", "text")]
    return met.select(media, "pos", *fields)


def fits(left_over: str | None = None) -> Column:
    """Whether a pair has both cues, of equal number and timing, and a target that isn't blank."""
    ok = (F.col("source_idx") == F.col("target_idx")) & (F.col("source_timing") == F.col("target_timing")) & (X.strip(F.col("target_text")) != "")
    if left_over:
        ok = ok & ~X.has(F.col("target_text"), left_over)
    return F.coalesce(ok, F.lit(False))


def alignment(source: DataFrame, target: DataFrame, media: str = "media_id", order: str = "idx", left_over: str | None = None) -> DataFrame:
    """media, pairs, aligned: whether all pairs of a medium fit (and no target holds a character of the class ``left_over``)."""
    return pairs(source, target, media, order).groupBy(media).agg(F.count("*").alias("pairs"), F.bool_and(fits(left_over)).alias("aligned"))


def stacked(source: DataFrame, target: DataFrame, media: str = "media_id", order: str = "idx") -> DataFrame:
    """Both texts in one cue, the target's above; only for media that are aligned."""
    p = pairs(source, target, media, order).withColumn("_all", F.bool_and(fits()).over(Window.partitionBy(media))).filter("_all")
    return p.select(media, F.col("source_idx").alias("idx"), F.col("source_timing").alias("timing"), F.concat_ws("\n", X.strip(F.col("target_text")), X.strip(F.col("source_text"))).alias("text"))

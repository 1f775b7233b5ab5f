"""Gates and the next action of a collection, from one row of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_action(
    lock: Column, healthy: Column, videos: Column, sample_approved: Column, video_approved: Column,
    full_review_current: Column, sample_review_current: Column, first_has_target: Column, targets: Column,
) -> Column:
    """The first of these that applies."""
    return (
        F.when(lock == "unreadable", "resolve_failure")
        .when(~healthy, "bootstrap")
        .when(lock == "active", "monitor")
        .when(videos == 0, "add_videos")
        .when(~sample_approved & ~video_approved & full_review_current, "review_full_video")
        .when(~sample_approved & ~video_approved & sample_review_current, "review_sample")
        .when(~sample_approved & ~video_approved, "run_sample")
        .when(~video_approved & first_has_target, "review_full_video")
        .when(~video_approved, "process_first_video")
        .when(targets < videos, "resume")
        .otherwise("validate")
    )


def review_current(gates: DataFrame, present: DataFrame) -> DataFrame:
    """Sample reviews with current: they await review, and settings and both artifacts are what they were.

    ``present``: media, fingerprint, source_sha256, target_sha256 as they are now.
    """
    now = present.select("media", *(F.col(c).alias(f"_{c}") for c in ("fingerprint", "source_sha256", "target_sha256")))
    same = F.col("status").eqNullSafe("awaiting_review")
    for c in ("fingerprint", "source_sha256", "target_sha256"):
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return gates.join(now, "media", "left").withColumn("current", same).select(*gates.columns, "current")


def approval_current(approvals: DataFrame, reviews: DataFrame, settings_fingerprint: Column) -> DataFrame:
    """Approvals with approved: their review is current and is the one that was approved."""
    r = reviews.select("media", F.col("current").alias("_c"), F.sha2(F.concat_ws("|", settings_fingerprint, F.to_json(F.struct("fingerprint", "media", "source_sha256", "status", "target_sha256"))), 256).alias("_review"))
    ok = F.coalesce(F.col("_c") & (F.col("fingerprint") == settings_fingerprint) & (F.col("review_fingerprint") == F.col("_review")), F.lit(False))
    return approvals.join(r, "media", "left").withColumn("approved", ok).drop("_c", "_review")


def video_gate(media: DataFrame, alignment: DataFrame, verdicts: DataFrame, provenance: DataFrame) -> DataFrame:
    """media_id, open: aligned tracks, a sound source transcript and current provenance of both stages."""
    p = provenance.groupBy("media_id").agg((F.count_if(F.col("provenance") == "current") == 2).alias("_p"))
    t = media.select("media_id").join(alignment.select("media_id", "aligned"), "media_id", "left").join(verdicts.select("media_id", "errors"), "media_id", "left").join(p, "media_id", "left")
    opened = F.coalesce("aligned", F.lit(False)) & F.coalesce(F.size("errors") == 0, F.lit(False)) & F.coalesce("_p", F.lit(False))
    return t.select("media_id", opened.alias("open"))

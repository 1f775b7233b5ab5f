"""Validation of a collection: ordered rules, of which the first failure of a file counts.

All tables are dealt out by medium once: rules over neighbours, first failures, alignment and the joins
with what is known about each file follow in that one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SLACK_MS = 2000


def dealt(rows: DataFrame, key: str, share: int = 1 << 20) -> DataFrame:
    """``rows`` dealt out by ``key`` into a part for each ``share`` bytes of the files that they come from.

    What follows in that partitioning keeps several sorts in one task, so a task must not grow with the
    input.  Rows of which no size is known, such as those of a checkpoint, are left as they are.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return rows.repartition(max(1, -(-size // share)), key) if 0 < size < 1 << 60 else rows


def first_rule(rules: list[tuple[Column, Column]]) -> Column:
    """The message of the first rule that fails, null if none does."""
    found = None
    for test, message in rules:
        found = F.when(test, message) if found is None else found.when(test, message)
    return found


def cue_rules(left_over: str, target: Column) -> Column:
    """What is wrong with a cue, given its number in the file (_rn) and the start before it (_before)."""
    at = F.col("idx").cast("string")
    return first_rule(
        [
            (F.col("idx") != F.col("_rn"), F.concat(F.lit("cue index "), at, F.lit(", expected "), F.col("_rn").cast("string"))),
            ((F.col("start_ms") < F.col("_before")) | (F.col("end_ms") <= F.col("start_ms")) | (F.col("end_ms") > F.col("duration_ms") + SLACK_MS), F.concat(F.lit("invalid cue timing at "), at)),
            (target & X.has(F.col("text"), left_over), F.concat(F.lit("Japanese script remains at cue "), at)),
        ]
    )


def _tracks(media: DataFrame, cues: DataFrame, left_over: str, source: str, target: str) -> DataFrame:
    """media_id, and for both languages the number of cues and the first failure; whether the tracks are aligned."""
    w = Window.partitionBy("media_id", "lang").orderBy("pos")
    c = cues.join(media.select("media_id", "duration_ms"), "media_id")
    c = c.withColumn("_rn", F.row_number().over(w)).withColumn("_before", F.coalesce(F.lag("start_ms").over(w), F.lit(-1)))
    c = c.withColumn("_m", cue_rules(left_over, F.col("lang") == target))
    cue = F.struct("idx", "timing", "text", "_m")
    own = lambda lang: F.max(F.when(F.col("lang") == lang, cue))
    p = c.groupBy("media_id", "_rn").agg(own(source).alias("_s"), own(target).alias("_t"))
    good = (F.col("_s.idx") == F.col("_t.idx")) & (F.col("_s.timing") == F.col("_t.timing")) & (X.strip(F.col("_t.text")) != "")
    bad = lambda s: F.min_by(F.col(f"{s}._m"), F.when(F.col(f"{s}._m").isNotNull(), F.col("_rn")))
    return p.groupBy("media_id").agg(F.count("_s").alias("_s_cues"), F.count("_t").alias("_t_cues"), bad("_s").alias("_s_bad"), bad("_t").alias("_t_bad"), F.bool_and(F.coalesce(good, F.lit(False))).alias("_aligned"))


def report(media: DataFrame, cues: DataFrame, facts: DataFrame, left_over: str, source: str = "ja", target: str = "zh-Hans") -> DataFrame:
    """The validation report: media_id, tier, status, name, detail.

    ``media``: media_id, name, duration_ms.  ``cues``: media_id, lang, pos, idx, timing, start_ms, end_ms, text.
    ``facts``: a row for each sidecar that exists: media_id, lang, parse_error, quality_error, provenance
    (current, stale, missing).  Each medium has a row for each language and, where both passed, one for
    their alignment.
    """
    known = F.struct("parse_error", "quality_error", "provenance")
    of = lambda lang: F.max(F.when(F.col("lang") == lang, known))
    f = facts.groupBy("media_id").agg(of(source).alias("_s"), of(target).alias("_t"))
    t = media.join(f, "media_id", "left").join(_tracks(media, cues, left_over, source, target), "media_id", "left")

    def verdict(s: str, stage: str, judged: bool) -> Column:
        fact = lambda k: F.col(f"{s}.{k}")
        rules = [
            (F.col(s).isNull(), F.lit("missing")),
            (fact("parse_error").isNotNull(), fact("parse_error")),
            (F.coalesce(F.col(f"{s}_cues"), F.lit(0)) == 0, F.lit("subtitle contains zero cues")),
            *([(fact("quality_error").isNotNull(), fact("quality_error"))] if judged else []),
            (fact("provenance") == "missing", F.lit(f"missing or malformed {stage} provenance")),
            (fact("provenance") == "stale", F.lit(f"stale {stage} provenance")),
        ]
        return first_rule(rules).otherwise(F.col(f"{s}_bad"))

    t = t.withColumn("_s_fail", verdict("_s", "transcription", True)).withColumn("_t_fail", verdict("_t", "translation", False))

    def line(tier: int, failed: Column, name: Column, passed: Column, why: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.when(failed, "FAIL").otherwise("PASS").alias("status"), name.alias("name"), F.when(failed, why).otherwise(passed).alias("detail"))

    def file(tier: int, s: str, lang: str) -> Column:
        fail = F.col(f"{s}_fail")
        return line(tier, fail.isNotNull(), F.concat("name", F.lit(f".{lang}.srt")), F.concat(F.col(f"{s}_cues").cast("string"), F.lit(" cues")), fail)

    both = F.col("_s_fail").isNull() & F.col("_t_fail").isNull()
    pair = line(2, ~F.col("_aligned"), F.col("name"), F.lit("Japanese/Chinese cues aligned"), F.lit("Japanese/Chinese cue count, index, or timing mismatch"))
    lines = F.array_compact(F.array(file(0, "_s", source), file(1, "_t", target), F.when(both, pair)))
    return t.select("media_id", F.inline(lines))

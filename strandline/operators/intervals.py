"""Merging and measuring intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.text import let


def merge_gaps(intervals: DataFrame, part: Sequence[str], gap: float = 0.2, least: float = 0.2, start: str = "start", end: str = "end") -> DataFrame:
    """Join intervals with at most ``gap`` between them, in order, and keep those of at least ``least``.

    For intervals whose ends grow with their starts, such as frames.  Times stay doubles: whether a gap
    of just that size joins depends on their rounding, as it should.
    """
    w = Window.partitionBy(*part).orderBy(start, end)
    before = F.lag(end).over(w)
    opens = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    islands = intervals.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*part, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    return merged.filter(F.col(end) - F.col(start) >= least)


def coverage(intervals: DataFrame, segments: DataFrame, part: Sequence[str], bucket: float = 300.0) -> DataFrame:
    """``intervals`` with coverage: clipped overlaps with segments, added up (not united), over the length, at most 1.

    A range join by time buckets: each side is listed in the buckets that it touches, which makes it an
    equi-join, and a pair counts in the bucket where its overlap begins.
    """
    keys = [*part, "_s", "_e"]
    spread = lambda d, a, b: d.withColumn("_b", F.explode(F.sequence(F.floor(a / bucket).cast("long"), F.greatest(F.floor(a / bucket), F.floor(b / bucket)).cast("long"))))
    left = spread(intervals.select(*part, F.col("start").alias("_s"), F.col("end").alias("_e")).distinct(), F.col("_s"), F.col("_e"))
    right = spread(segments.filter("end > start").select(*part, F.col("start").alias("_x"), F.col("end").alias("_y")), F.col("_x"), F.col("_y"))
    met = left.join(right, [*part, "_b"]).filter((F.col("_x") < F.col("_e")) & (F.col("_y") > F.col("_s")))
    met = met.filter(F.floor(F.greatest("_s", "_x") / bucket).cast("long") == F.col("_b"))
    sums = met.groupBy(*keys).agg(F.sum(F.least("_e", "_y") - F.greatest("_s", "_x")).alias("_covered"))
    length = F.greatest(F.lit(0.001), F.col("end") - F.col("start"))
    share = F.least(F.lit(1.0), F.coalesce("_covered", F.lit(0.0)) / length)
    found = intervals.withColumns({"_s": F.col("start"), "_e": F.col("end")}).join(sums, keys, "left")
    return found.select(*intervals.columns, share.alias("coverage"))


def capped_merge_array(spans: Column, duration: Column, pad: float = 1.0, gap: float = 0.5, cap: float = 15.0, stride: float = 14.0, least: float = 0.2) -> Column:
    """Pad, clip, sort and merge an array of struct<start, end> up to ``cap`` long; longer ones are cut into overlapping pieces.

    A fold in order, as each step depends on the last merged interval, which stays open while the ones
    before it are gathered.
    """
    kind = "struct<start:double,end:double>"
    padded = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0.0), s["start"] - pad).alias("start"), F.least(duration, s["end"] + pad).alias("end")))
    none = F.lit(None).cast(kind)

    def whole(s: Column, n: Column) -> Column:
        """The pieces that are cut off while more than the cap remains."""
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k < n), lambda k: F.struct((s["start"] + k * stride).alias("start"), (s["start"] + k * stride + cap).alias("end")))

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        n = F.greatest(F.lit(0), F.ceil((s["end"] - s["start"] - cap) / stride).cast("int"))
        joins = F.coalesce((s["start"] - last["end"] <= gap) & (s["end"] - last["start"] <= cap), F.lit(False))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        rest = F.struct((s["start"] + n * stride).alias("start"), s["end"].alias("end"))
        closed = F.when(last.isNull(), acc["done"]).otherwise(folds.push(acc["done"], last))
        more = F.when(n > 0, F.aggregate(whole(s, n), closed, folds.push)).otherwise(closed)
        return F.struct(F.when(joins, acc["done"]).otherwise(more).alias("done"), F.when(joins, longer).otherwise(rest).alias("last"))

    def end(acc: Column) -> Column:
        return folds.gathered(F.when(acc["last"].isNull(), acc["done"]).otherwise(folds.push(acc["done"], acc["last"])))

    merged = F.aggregate(F.array_sort(padded), F.struct(folds.nothing(kind).alias("done"), none.alias("last")), step, end)
    return F.filter(merged, lambda s: s["end"] - s["start"] >= least)


def capped_merge(spans: DataFrame, part: Sequence[str], duration: str = "duration", **how) -> DataFrame:
    """Rows (part, start, end, duration) -> merged rows (part, interval_no, start, end)."""
    grouped = spans.groupBy(*part).agg(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))).alias("_s"), F.max(duration).cast("double").alias("_d"))
    out = grouped.select(*part, F.posexplode(capped_merge_array(F.col("_s"), F.col("_d"), **how)).alias("interval_no", "_i"))
    return out.select(*part, "interval_no", "_i.start", "_i.end")


def rescue_intervals(activity: DataFrame, segments: DataFrame, part: Sequence[str], durations: DataFrame, flag: float = -0.85, bare: float = 0.2) -> DataFrame:
    """What to look at again: loud intervals hardly covered by segments, and segments of low confidence."""
    uncovered = coverage(activity, segments, part).filter(F.col("coverage") < bare).select(*part, "start", "end")
    weak = segments.filter(F.coalesce("avg_logprob", F.lit(-99.0)) < flag).select(*part, "start", "end")
    return capped_merge(uncovered.unionByName(weak).join(durations, list(part)), part)


def rescue_merge(primary: DataFrame, candidates: DataFrame, part: Sequence[str], flag: float = -0.85, better: float = 0.1, share: float = 0.3) -> DataFrame:
    """Fold candidates into primary segments (part, seq, start, end, text, avg_logprob), in order.

    A candidate that overlaps none is added, and seen by later ones; one that overlaps just one replaces
    it if that is weak and the candidate better; others are dropped.  The list changes as it is
    scanned, so what overlaps in time, directly or by others, is folded as a whole; the rest of a group can't
    meet it.  What is left comes in no order of rows; ``order`` numbers a group by start and end, of equals
    the earlier in the list first.
    """
    fields = ["start", "end", "seq", "text", "avg_logprob"]
    base = primary.select(*part, F.lit(0).alias("_side"), *fields).unionByName(candidates.select(*part, F.lit(1).alias("_side"), *fields))
    one = F.struct(*(F.col(f).cast(base.schema[f].dataType).alias(f) for f in fields))
    listed = F.struct("_side", "seq", one.alias("r"))
    # A place in the list stays when what is there is replaced.
    w = Window.partitionBy(*part).orderBy("start", "end")
    opens = F.when(F.col("start") < F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    islands = base.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = islands.groupBy(*part, "_island").agg(F.transform(F.array_sort(F.collect_list(listed)), lambda x: F.struct(x.alias("place"), x["r"].alias("r"))).alias("_all"))
    kind = rows.schema["_all"].dataType.simpleString()
    side = lambda k: F.filter("_all", lambda x: x["place"]["_side"] == k)
    prob = lambda x: F.coalesce(x["r"]["avg_logprob"], F.lit(-99.0))

    def meets(a: Column, b: Column) -> Column:
        c, e = a["r"], b["r"]
        common = F.greatest(F.lit(0.0), F.least(c["end"], e["end"]) - F.greatest(c["start"], e["start"]))
        return common >= F.greatest(F.lit(0.1), F.least(c["end"] - c["start"], e["end"] - e["start"])) * share

    def step(kept: Column, c: Column) -> Column:
        hits = F.filter(F.transform(kept, lambda e, k: F.when(meets(c, e), k)), lambda k: k.isNotNull())

        def decide(at: Column) -> Column:
            old = F.get(kept, at[0])
            wins = (F.size(at) == 1) & (prob(old) < flag) & (prob(c) > prob(old) + better)
            taken = F.struct(old["place"].alias("place"), c["r"].alias("r"))
            return F.when(F.size(at) == 0, F.array_append(kept, c)).when(wins, F.transform(kept, lambda e, k: F.when(k == at[0], taken).otherwise(e))).otherwise(kept)

        return let(hits, decide).cast(kind)

    # Most of what overlaps nothing is one row.
    merged = F.when(F.size("_all") == 1, F.col("_all")).otherwise(F.aggregate(side(1), side(0).cast(kind), step))
    folded = rows.select(*part, F.inline(merged))
    at = F.row_number().over(Window.partitionBy(*part).orderBy("r.start", "r.end", "place")) - 1
    return folded.select(*part, at.alias("order"), "r.seq", "r.start", "r.end", "r.text", "r.avg_logprob")

"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order, twice over (a second epoch after the first), and are
served in packets of at most ``PACKET`` words, a document's last one what is left.  A packet's virtual
finish time is the words of its source up to and including it, divided by the source's target; a
document's is that of its last packet.  All packets of all sources in the order of their finish times are
cut where their words reach the total budget.  Sources so come within a packet of their targets.

The order is global, yet nothing is sorted as a whole: words are added up by ranges of the finish time,
the range in which the budget ends is cut into ranges again, and only what is left of it is sorted.  The
packet found there says of every other one, by its own finish time alone, on which side of the cut it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, stored

WEIGHTS = (3, 1, 2)
BUDGET, MOST_EPOCHS = 1.5, 2
#: Words of a packet.
PACKET = 16
#: Ranges of the finish time at each level (a power of two), levels, and packets that are sorted at once.
RANGES, LEVELS, SORTED = 4096, 4, 100_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target and rank: shares by weight, none above ``epochs`` times its source.

    Sources take the weights in turn by code point, null last.  In the order of limit per weight, each
    source is held to its limit while an even share of what is left would go above it.  There is one row a
    source here, which is what one task orders.
    """
    t = sizes.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") - 1) % len(weights) + 1)
    t = t.select("source", "source_size", "rank", pick.alias("w"), (F.col("source_size") * float(epochs)).alias("top"))
    order = [F.col("top") / F.col("w"), F.col("source").asc_nulls_last()]
    whole, ahead = Window.partitionBy(), Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0.0))
    level = (F.sum("source_size").over(whole) * float(budget) - spent("top")) / (F.sum("w").over(whole) - spent("w"))
    t = t.select("*", F.row_number().over(Window.orderBy(*order)).alias("k"), level.alias("level"))
    free = F.min(F.when(F.col("top") > F.col("level") * F.col("w"), F.struct("k", "level"))).over(whole)
    t = t.withColumn("free", free)
    held = F.col("free").isNull() | (F.col("k") < F.col("free.k"))
    return t.select("source", "source_size", F.when(held, F.col("top")).otherwise(F.col("free.level") * F.col("w")).alias("target"), "rank")


def shuffle_key(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of a digest of seed and id: the shuffled order; null ids count as the text 'null'."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Cut:
    """Where the budget ends: packets before (finish, rank) are served, this one with ``words`` words, no later one."""

    finish: float
    rank: int
    words: int


def _finish(words: Column, epoch: int) -> Column:
    """The virtual time at which so many words of a document, and all before it, are served."""
    return (F.col("start") + F.lit(epoch) * F.col("source_size") + words).cast("double") / F.col("target")


def _packets(epoch: int, packet: int) -> Column:
    """An array of struct<words, finish> for the packets of a document in an epoch.

    Columns: size, start (words of its source before it), source_size and target.
    """

    def one(k: Column) -> Column:
        words = F.least(F.lit(packet), F.col("size") - k * packet).cast("long")
        return F.struct(words.alias("words"), _finish(k * packet + words, epoch).alias("finish"))

    each = F.transform(F.sequence(F.lit(0), F.ceil(F.col("size") / packet).cast("int") - 1), one)
    return F.when((F.col("size") > 0) & (F.col("target") > 0), each).otherwise(F.array().cast("array<struct<words:bigint,finish:double>>"))


def _digits(finish: Column) -> list[Column]:
    """The range of a finish time at each level: the digits of finish / (1 + finish), exact as RANGES is a power of two."""
    x, out = finish / (finish + 1), []
    for _ in range(LEVELS):
        x = x * RANGES
        out.append(F.floor(x).cast("int"))
        x = x - F.floor(x)
    return out


def cut(scheduled: DataFrame, budget: int, epochs: int = MOST_EPOCHS, packet: int = PACKET) -> Cut:
    """Where the packets of ``scheduled``, in the order of (finish, rank), reach ``budget`` words.

    Ranks tell sources apart; within one, finish times grow.  The driver sees sums of RANGES ranges a level
    and one row.  Is the budget never reached, all packets are served.
    """
    rows = scheduled.select("rank", F.inline(F.concat(*(_packets(e, packet) for e in range(epochs)))))
    left, before = budget, []
    for level in range(LEVELS):
        inside = rows
        for k, at in enumerate(before):
            inside = inside.filter(_digits(F.col("finish"))[k] == at)
        sums = inside.groupBy(_digits(F.col("finish"))[level].alias("at")).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
        for r in sorted(sums.collect(), key=lambda r: r.at):
            if r.words >= left:
                before.append(r.at)
                break
            left -= r.words
        else:
            return Cut(float("inf"), 0, 0)
        if r.n <= SORTED:
            break
    for k, at in enumerate(before):
        rows = rows.filter(_digits(F.col("finish"))[k] == at)
    # what is left is one range, which is as small as the levels make it
    run = F.sum("words").over(Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.withColumn("run", run).filter(F.col("run") >= left).orderBy("finish", "rank").first()
    return Cut(last.finish, last["rank"], last.words - (last.run - left))


def taken(at: Cut, epochs: int = MOST_EPOCHS, packet: int = PACKET) -> Column:
    """How many words of a document are served before the cut, over all epochs."""

    none = F.lit(0).cast("long")

    def served(p: Column) -> Column:
        whole = (p["finish"] < at.finish) | ((p["finish"] == at.finish) & (F.col("rank") < at.rank))
        return F.when(whole, p["words"]).when((p["finish"] == at.finish) & (F.col("rank") == at.rank), F.lit(at.words).cast("long")).otherwise(none)

    def of(epoch: int) -> Column:
        # most documents lie on one side of the cut with all their packets
        some = F.aggregate(_packets(epoch, packet), none, lambda n, p: n + served(p))
        sides = F.when(_finish(F.col("size"), epoch) < at.finish, F.col("size")).when(_finish(F.lit(0), epoch) > at.finish, none).otherwise(some)
        return F.when(F.col("target") > 0, sides).otherwise(none)

    total = none
    for e in range(epochs):
        total = total + of(e)
    return total


def schedule(
    docs: DataFrame, seed: str = "mix", keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = MOST_EPOCHS, packet: int = PACKET
) -> DataFrame:
    """One row for each of ``docs``: row (a struct of ``keep``), source, size, source_size, target, taken, finish.

    ``taken`` counts the words that the mix serves of the document, over all epochs; ``finish`` is the
    virtual finish time of its first epoch, null in a source without words.  The order within a source
    is by digest of the id, then id and size.  Running sums go over digest ranges of a source, which are
    moved by the words before them: a source that holds most rows is not one task.  Null and blank texts
    have no words and are never taken; null is a source like others; repeated rows are served each; an
    empty table gives no rows; columns of ``docs`` with the names of results don't disturb.
    """
    queue = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), "source", count_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key"))
    small = stored(queue.drop("row"), "mix-queue")  # without what is kept, such as texts, which are read again instead
    bits = min(16, max(0, (small.count() // 500).bit_length()))
    ranged = lambda rows: rows.withColumn("range", F.shiftright("key", 60 - bits).cast("int"))
    sums = stored(ranged(small).groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    first = first.join(goal.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    own = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)

    def placed(rows: DataFrame) -> DataFrame:
        t = ranged(rows).join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        return t.withColumn("start", F.col("first") + F.sum("size").over(own) - F.col("size"))

    fields = ("source", "rank", "size", "start", "source_size", "target")
    times = stored(placed(small).select("id", *fields), "mix-times")
    words = sums.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    end = cut(times, int(words * budget), epochs, packet)
    t = times.select(F.struct(F.col("id").alias("doc_id")).alias("row"), *fields) if list(keep) == ["doc_id"] else placed(queue)
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")).cast("double") / F.col("target"))
    return t.select("row", "source", "size", "source_size", "target", taken(end, epochs, packet).alias("taken"), finish.alias("finish"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix in the order of their virtual finish times, with the columns of ``docs``.

    Whole documents only: one served by half or more in an epoch is there once for that epoch, so a
    source is off its target by less than half a document.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")).otherwise(0)
    plan = schedule(docs, keep=docs.columns, **how).select("row", "finish", "source_size", "target", times.alias("times"))
    turns = plan.filter("times > 0").select("row", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.col("finish") + (k - 1) * F.col("source_size") / F.col("target"))).alias("at"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return turns.repartitionByRange(int(parts), "at").sortWithinPartitions("at").select("row.*")

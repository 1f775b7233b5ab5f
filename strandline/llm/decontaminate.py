"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at five words out of six and ignore one.  The seeds of all document positions meet
those of the benchmark; each hit says how a document and an item may be laid over each other, and this
overlap is verified word by word.  A document is contaminated by an item if, laid over it without gaps,
it has at least ``share`` of the item's words at their places: words may be substituted, not inserted.

With share 0.8 the two masks find every overlap of 15 words, whichever three are substituted.  Items of
6 to 14 words may lose one or two, which leaves three in a row: they are sought by a shorter mask, which
documents are hashed with only if the benchmark has such items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, sized, stored

MASKS = ("111011", "101111")
SHORT_MASKS, SHORT_ITEMS = ("111",), (6, 14)
SHARE = 0.8
#: Tables of up to so many rows of a few numbers are broadcast: seeds of the benchmark, hits, keys of bad documents.
#: Larger ones are joined by shuffle, seeds in so many shares of each, so that one in all documents is no single task.
BROADCAST_SEEDS, SHARES = 1_000_000, 16
#: Items are broadcast while their texts have so few bytes.
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def seeds(rows: DataFrame, keys: Sequence[str], masks: Sequence[str] = MASKS) -> DataFrame:
    """(keys, words) -> (keys, pos, seed): a row for each mask at each position where it fits."""
    span = len(masks[0])
    if any(len(m) != span for m in masks):
        raise ValueError("masks have one length")

    def shifted(h: Column) -> Column:
        n = F.greatest(F.size(h) - (span - 1), F.lit(0))
        return F.arrays_zip(*(F.slice(h, k + 1, n).alias(f"w{k}") for k in range(span)))

    hashed = let(F.transform("words", lambda w: F.xxhash64(w)), shifted)
    at = rows.select(*keys, F.posexplode(hashed).alias("pos", "z"))
    own = [F.xxhash64(F.lit(m), *(F.col(f"z.w{i}") for i, bit in enumerate(m) if bit == "1")) for m in masks]
    return at.select(*keys, "pos", F.explode(F.array(*own)).alias("seed"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows of the same id and text share a key; it tells apart rows without an id too."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k_id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("k_text"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, masks: Sequence[str] = MASKS) -> DataFrame:
    """k_id, k_text, doc_id, item_id, n_words, matched: the best overlap of each contaminated document and item.

    Every row of both tables takes part with its whole text.  Null or blank texts, and items of fewer than
    six words, which are evidence of nothing, overlap with nothing.  Rows equal in id and text give one row;
    equal ids with other texts give one each, and rows without an id are told apart by their texts.  Items
    with a repeated id are told apart by their texts, and reported by id.  Other columns are ignored; an
    empty table on either side gives no rows.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).distinct()
    items = items.select("item_id", F.xxhash64("words").alias("i_key"), F.size("words").alias("n_words"), F.col("words").alias("i_words"))
    least, most = SHORT_ITEMS
    items = items.filter(F.col("n_words") >= least)
    own = lambda rows, m: seeds(rows.select("item_id", "i_key", F.col("i_words").alias("words")), ["item_id", "i_key"], m).withColumnRenamed("pos", "i_pos")
    item_seeds = own(items.filter(F.col("n_words") > most), masks)
    families = [masks]
    if items.filter(F.col("n_words") <= most).limit(1).count():
        item_seeds = item_seeds.unionByName(own(items.filter(F.col("n_words") <= most), SHORT_MASKS))
        families.append(SHORT_MASKS)
    keyed = _keyed(docs)
    worded = keyed.select("k_id", "k_text", tokens(F.col("text")).alias("words"))
    mine = seeds(worded, ["k_id", "k_text"], families[0])
    for m in families[1:]:
        mine = mine.unionByName(seeds(worded, ["k_id", "k_text"], m))
    if item_seeds.count() <= BROADCAST_SEEDS:
        met = mine.join(F.broadcast(item_seeds), "seed")
    else:
        some = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
        met = mine.withColumn("share", F.pmod(F.xxhash64("k_id", "k_text", "pos"), F.lit(SHARES)).cast("int")).join(item_seeds.withColumn("share", some), ["seed", "share"])
    hit = stored(met.select("k_id", "k_text", "item_id", "i_key", (F.col("pos") - F.col("i_pos")).alias("off")).distinct(), "seed-hits")
    # hits are few, so they go to the texts and not the other way round
    both = keyed.join(sized(hit, BROADCAST_SEEDS), ["k_id", "k_text"]).select("k_id", "k_text", "doc_id", "item_id", "i_key", "off", tokens(F.col("text")).alias("d_words"))
    text_bytes = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = F.broadcast(items) if text_bytes <= BROADCAST_BYTES else items
    both = both.join(small, (both.i_key == items.i_key) & both.item_id.eqNullSafe(items.item_id)).select("k_id", "k_text", "doc_id", both.item_id, "n_words", "off", "d_words", "i_words")
    d_from, i_from = F.greatest("off", F.lit(0)), F.greatest(-F.col("off"), F.lit(0))

    def same(d: Column) -> Column:
        n = F.greatest(F.least(F.size(d) - d_from, F.col("n_words") - i_from), F.lit(0))
        equal = F.zip_with(F.slice(d, d_from + 1, n), F.slice("i_words", i_from + 1, n), lambda a, b: F.when(a == b, 1))
        return F.size(F.array_compact(equal))

    done = both.select("k_id", "k_text", "doc_id", "item_id", "n_words", let(F.col("d_words"), same).alias("matched"))
    done = done.filter(F.col("matched") >= F.ceil(F.col("n_words") * F.lit(share) - 1e-9))
    return done.groupBy("k_id", "k_text", "doc_id", "item_id").agg(F.max("n_words").cast("long").alias("n_words"), F.max("matched").cast("long").alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns, whatever their names.

    Rows are judged by id and text, so null ids, repeated rows and ids with several texts are judged each;
    null and blank texts stay; an empty table stays empty, and an empty benchmark keeps all rows.
    """
    bad = stored(overlaps(docs, benchmark, **how).select("k_id", "k_text").distinct(), "contaminated")
    bad = sized(bad, BROADCAST_SEEDS)
    on = (F.coalesce(docs.doc_id.cast("long"), F.lit(-1)) == bad.k_id) & (F.xxhash64(docs.doc_id.isNull(), docs.text) == bad.k_text)
    return docs.join(bad, on, "left_anti")

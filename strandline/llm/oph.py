"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each five-word shingle is hashed once.  The top bits of the hash name its bin, and a bin holds the least
hash that falls into it.  An empty bin copies the first filled one in a probing order of its own, which
is the same for all documents.  Of each bin the low ``BITS`` bits are stored.  Two bins of unlike
documents still agree by chance in one of 2^BITS cases, which the estimate of likeness takes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, words

BINS, BITS, SHINGLE, PROBES = 128, 8, 5, 24


def _probe(bin_no: int, attempt: int, bins: int) -> int:
    """A pseudo-random bin for each bin and attempt, by a multiply-shift mix."""
    x = (bin_no * 0x9E3779B97F4A7C15 + attempt * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & ((1 << 64) - 1)
    x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return (x >> 32) % bins


def hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """One 64-bit hash for each shingle; fewer words are one shingle, no words none."""

    def shingled(h: Column) -> Column:
        n = F.size(h) - (shingle - 1)
        many = F.transform(F.arrays_zip(*(F.slice(h, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(shingle))), lambda z: F.xxhash64(z))
        return F.when(n > 0, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)), shingled)


def bin_minima(hashed: Column, bins: int = BINS) -> Column:
    """The array of the bins' least hashes, null for an empty bin."""
    shift = 64 - (bins - 1).bit_length()
    home = lambda h: F.shiftright(h, shift)  # noqa: E731  from -bins/2 to bins/2 - 1, in the order of the hashes

    def fill(s: Column) -> Column:
        first = F.filter(s, lambda h, k: (k == 0) | (home(h) != home(F.get(s, k - 1))))
        return let(first, lambda f: F.when(F.size(f) == bins, f).otherwise(spread(f)))

    def spread(f: Column) -> Column:
        return let(F.transform(f, home), lambda at: F.transform(F.sequence(F.lit(-bins // 2), F.lit(bins // 2 - 1)), lambda b: F.get(f, (F.array_position(at, b.cast("long")) - 1).cast("int"))))

    return let(F.sort_array(hashed), fill)


def densify(minima: Column, bins: int = BINS, probes: int = PROBES) -> Column:
    """Empty bins get the value of the first filled one in their probing order; no filled bin gives zeros."""
    tables = [F.lit([_probe(b, t, bins) for b in range(bins)]) for t in range(probes)]

    def fill(v: Column) -> Column:
        # past the probes, the filled bin with the least digest of the pair ends the search
        rest = lambda j: F.array_min(F.transform(v, lambda x, k: F.when(x.isNotNull(), F.struct(F.xxhash64(j, k).alias("d"), x.alias("x")))))["x"]
        return F.transform(v, lambda x, j: F.coalesce(x, *(F.get(v, F.get(t, j)) for t in tables), rest(j), F.lit(0).cast("long")))

    return let(minima, fill)


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """The packed fingerprint as lower-case hex, two digits a bin; the empty string for a text without words."""
    hexed = [f"{k:02x}" for k in range(1 << BITS)]
    pack = lambda v: F.array_join(F.transform(v, lambda x: F.get(F.lit(hexed), x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))), "")
    return let(hashes(text), lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(let(densify(bin_minima(h, bins), bins), pack)))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """The estimated share of common shingles, from 0 to 1: agreeing bins without those that agree by chance.

    Two texts without words are alike, one is unlike any with words.
    """
    chance = 2.0**-BITS
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.substring(a, k * 2 + 1, F.lit(2)) == F.substring(b, k * 2 + 1, F.lit(2))))
    corrected = F.greatest(F.lit(0.0), (agree / bins - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(corrected)


#: At most so many ranges of ids, and so many sampled rows a range to find where they begin.
RANGES, SAMPLED = 1 << 16, 40


def _order(rows: DataFrame) -> DataFrame:
    """doc_id, text and the columns by which rows are ordered: has (an id or none), id, tie (a hash of the text)."""
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("tie"))


def in_ranges(docs: DataFrame, rows_a_range: int = 250) -> DataFrame:
    """The rows of ``_order`` with range, which grows with the order and holds about as many rows each time.

    Ranges begin at quantiles of a sample, taken by a hash of id and text, of about SAMPLED rows a range, so
    clustered ids and one id of many texts are split like others; only equal rows stay together.  Where a
    row lies is found by a binary search over at most RANGES ends, which are a literal.
    """
    doc, n = _order(docs), docs.count()
    ranges = max(1, min(RANGES, n // rows_a_range))
    key = ["has", "id", "tie"]
    some = doc.filter(F.pmod(F.xxhash64(*key), F.lit(max(1, n // (SAMPLED * ranges)))) == 0).groupBy(*key).agg(F.count("*").alias("n"))
    ordered, whole = Window.orderBy(*key), Window.partitionBy()
    run = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    some = some.select(*key, F.coalesce(F.floor(run * ranges / F.sum("n").over(whole)), F.lit(0)).alias("cell"))
    ends = some.withColumn("old", F.lag("cell").over(ordered)).filter("cell > old").orderBy(*key).select(*key).collect()
    if not ends:
        return doc.withColumn("range", F.lit(0))
    table = lambda k, kind: F.split(F.lit(",".join(str(int(e[k])) for e in ends)), ",").cast(f"array<{kind}>")
    has, ids, ties = table("has", "int"), table("id", "bigint"), table("tie", "bigint")

    def begun(k: Column) -> Column:
        """Whether the row lies at the k-th end or behind it."""
        h, i, t = F.get(has, k), F.get(ids, k), F.get(ties, k)
        own = F.col("has").cast("int")
        return (h < own) | ((h == own) & ((i < F.col("id")) | ((i == F.col("id")) & (t <= F.col("tie")))))

    steps = F.lit([1 << k for k in reversed(range(len(ends).bit_length()))])
    return doc.withColumn("range", F.aggregate(steps, F.lit(0), lambda at, s: F.when(begun(at + s - 1), at + s).otherwise(at)))


def fingerprint_next(docs: DataFrame, rows_a_range: int = 250) -> DataFrame:
    """Fingerprints of every row, of its edited text, and their likeness to each other and to the next row's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The next
    row is that of the next greater id, the first one after the last; null ids come first, rows with one id
    go by a hash of their texts; a lone row follows itself.  A null text is empty, an empty table gives no
    rows, other columns are ignored.  Rows are dealt out by ranges of about as many rows each, every range
    with a copy of the next one's first row, so a row and its next one meet.
    """
    doc = in_ranges(docs, rows_a_range)
    order = F.struct("has", "id", "tie")
    first = doc.groupBy("range").agg(F.min(order).alias("first"))
    whole = Window.partitionBy()
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(whole))
    first = F.broadcast(first.select(F.col("range").alias("r"), "first", before.alias("before")))  # at most RANGES rows
    led = doc.join(first, F.col("range") == F.col("r"))
    at = lambda guest, where: F.struct(F.lit(guest).alias("guest"), F.col(where).alias("range"))
    led = led.select("doc_id", "text", "has", "id", "tie", F.inline(F.when(order == F.col("first"), F.array(at(False, "range"), at(True, "before"))).otherwise(F.array(at(False, "range")))))
    onward = Window.partitionBy("range").orderBy("guest", "has", "id", "tie")
    led = led.withColumn("after", F.lead("text").over(onward))
    chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    led = led.select("range", "guest", "doc_id", "has", "id", "tie", "text", chars.cast("long").alias("n_chars"), F.concat(F.left("text", chars - half), F.left(F.coalesce("after", F.lit("")), half)).alias("edited"))
    none = F.lit(None).cast("string")
    led = led.select(
        "range", "guest", "doc_id", "has", "id", "tie", "n_chars", fingerprint(F.col("text")).alias("fingerprint"),
        F.when(~F.col("guest"), fingerprint(F.col("edited"))).otherwise(none).alias("edited_fingerprint"),
        F.when(~F.col("guest"), F.sha2(F.col("edited").cast("binary"), 256)).otherwise(none).alias("edited_sha256"),
    )
    led = led.withColumn("next_fingerprint", F.lead("fingerprint").over(onward)).filter(~F.col("guest"))
    return led.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

1. ``fingerprints``: 64-bit SimHash of every whole text over word shingles.
2. ``embed``: a fingerprint's 32 two-bit segments become 32 bit counts (0, 1 or 2), each written in
   unary (00, 01, 11).  The Manhattan distance of two embeddings is then the popcount of their XOR
   and never exceeds the Hamming distance of the fingerprints.
3. ``links``: the segments form ``max_bits + 3`` groups.  Two embeddings within Manhattan distance
   ``max_bits`` agree in every segment of at least three groups, so an equi-join on the grid cells
   of every three groups misses no pair.  The Manhattan bound, then the exact Hamming distance, filter it.
4. A crowded cell is never joined with itself.  Its members, whose links are exact anyway, meet in
   buckets of at most 65: each one is sent to its own value and the 64 values one bit away; two
   fingerprints share such a value if and only if they differ in at most two bits.
5. ``near_duplicates``: connected components over one representative for each distinct fingerprint.
6. ``keep_one``: all documents are searched for near copies with more edits too, whose fingerprints lie
   too far apart for any grid (see ``passages``), and grouped by both kinds of links at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, passing, ship, sized, stored
from .components import components
from .passages import SHARE, near_copies

_PAIRS = 0x5555555555555555
#: Rows of a fingerprint beyond which they aren't gathered by it.
HOT = 1_000_000


def _long(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; bytes.lower and bytes.split know ASCII only, as wanted."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return 0
    if len(found) < width:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(found[k:] for k in range(width)))), len(found) - width + 1
    hashes = map(xxh64_intdigest, shingles, repeat(seed))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        part = np.fromiter(hashes, dtype="<u8", count=min(1 << 16, n - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp for every row of ``docs``, repeated rows included; a null text counts as empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = [simhash(t.encode(), width, seed) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The bit counts of the 32 segments in unary: the odd bits say 'at least one', the even ones 'two'."""
    moved = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(moved).bitwiseAND(F.lit(_PAIRS))
    return F.shiftleft(fp.bitwiseAND(moved).bitwiseAND(F.lit(_PAIRS)), 1).bitwiseOR(some)


def cell_masks(max_bits: int) -> list[int]:
    """The bits that each family of grid cells looks at: three of ``max_bits + 3`` groups of segments."""
    groups = max_bits + 3
    cuts = [32 * k // groups for k in range(groups + 1)]
    bits = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [_long(sum(x)) for x in combinations(bits, 3)]


def links(distinct: DataFrame, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """(fp, rep) with distinct fp -> (u, v) of representatives, a spanning set of all links.

    Every pair of fingerprints that differ in at most ``max_bits`` bits is linked, directly or over
    others that are linked too.  ``crowd`` sets only which of two exact ways a cell goes.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("crowded cells are exact for at most two differing bits")
    point = distinct.select("fp", "rep", embed(F.col("fp")).alias("at"))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("at").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(cell_masks(max_bits)))))
    spread = point.select("fp", "rep", "at", cells.alias("c")).select("c.k", "c.cell", "fp", "rep", "at")
    sizes = spread.groupBy("k", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(spread.join(sizes, ["k", "cell"]), "simhash-cells")
    a, b = shared.filter(F.col("n") <= crowd).alias("a"), shared.filter(F.col("n") <= crowd).alias("b")
    bound = F.bit_count(F.col("a.at").bitwiseXOR(F.col("b.at"))) <= max_bits
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, same & bound & exact).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_long(1 << k))) for k in range(64)))
    one_off = F.col("fp") if max_bits == 0 else F.explode(near)
    hot = shared.filter(F.col("n") > crowd).select("fp", "rep").distinct().select(one_off.alias("value"), "fp", "rep")
    if max_bits == 1:  # sharing a value a bit away allows two bits; only the pairs around a member itself count
        own = hot.groupBy("value").agg(F.max(F.when(F.col("fp") == F.col("value"), F.col("rep"))).alias("hub"))
        star = hot.join(own.filter("hub is not null"), "value").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    else:
        buckets = hot.groupBy("value").agg(F.collect_list("rep").alias("reps")).filter(F.size("reps") > 1)
        star = buckets.select(F.explode("reps").alias("u"), F.array_min("reps").alias("v"))
    return pairs.unionByName(star.filter("u != v"))


def near_duplicates(docs: DataFrame, max_bits: int = 2, width: int = 3, seed: int = 42, crowd: int = 64, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``; component_id is the least doc_id reachable.

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows stay repeated.
    A row without a doc_id gets the component of its fingerprint, null if no row with an id has it.
    Other columns of ``docs`` are ignored, an empty table gives an empty result.  Rows of a fingerprint
    that more than ``hot`` of them have, and one in 10,000, meet its component where they are.
    """
    fps = stored(fingerprints(docs, width, seed), "simhash-fp", batch=TEXTS)
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(distinct.filter("rep is not null"), max_bits, crowd))
    home = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n")
    least = max(hot, fps.count() // 10_000)
    out = ("doc_id", "fp", "component_id")
    if not distinct.filter(F.col("n") > least).limit(1).count():
        return fps.join(home, "fp").select(*out)
    crowded = F.broadcast(stored(home.filter(F.col("n") > least), "simhash-hot"))  # fewer than 10,000 rows
    rest = fps.join(crowded.select("fp"), "fp", "left_anti").join(home, "fp")
    return fps.join(crowded, "fp").select(*out).unionByName(rest.select(*out))


def _one_text_an_id(docs: DataFrame) -> DataFrame:
    """``docs`` with _node: the id, or a hash of id and text for the rows of an id that several texts share."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(text).alias("_a"), F.max(text).alias("_b")).filter("_a != _b").select("_id")
    shared = stored(ids, "simhash-shared-ids")
    own = F.col("doc_id").cast("long")
    if not shared.limit(1).count():
        return docs.withColumn("_node", own)
    marked = docs.join(shared.withColumn("_shared", F.lit(True)), F.col("doc_id") == F.col("_id"), "left")
    return marked.withColumn("_node", F.when(F.col("_shared"), F.xxhash64("doc_id", text)).otherwise(own)).drop("_id", "_shared")


def keep_one(docs: DataFrame, max_bits: int = 2, width: int = 3, seed: int = 42, share: float | None = SHARE) -> DataFrame:
    """The rows of ``docs`` with one document of each group left: the one with the least doc_id.

    Groups are the components over the links of ``near_duplicates`` and those of near copies of similarity
    ``share`` (None: without these), found among all documents, so groups that meet in a document that goes
    are one.  Of repeated rows with an id that stays, one stays.  Rows of one id with different texts are
    documents of their own, which one of a group stays is then a matter of their hashes.  Rows without an
    id stay, as nothing tells them apart from a document that is kept.  Null and blank texts are one group;
    an empty table stays empty; further columns are kept, whatever their names.
    """
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    own = _one_text_an_id(own)
    nodes = own.select(F.col("_node").alias("doc_id"), "text")
    with passing(docs.sparkSession):
        found = stored(near_duplicates(nodes, max_bits, width, seed), "simhash-found")
        linked = stored(found.filter("doc_id != component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).distinct(), "simhash-linked")
        copies = linked if share is None else linked.unionByName(near_copies(nodes, share=share, known=linked))
        gone = stored(components(copies).select(F.col("node").alias("_node")), "simhash-gone", passes=False)
        twice = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_node")).agg(F.count("*").alias("n")).filter("n > 1")
        twice = stored(twice.select("_node"), "simhash-twice", passes=False)
    left = own.join(sized(gone), "_node", "left_anti")
    if twice.limit(1).count():
        again = left.join(sized(twice), "_node", "left_semi").dropDuplicates(["_node"])
        left = left.join(sized(twice), "_node", "left_anti").unionByName(again.select(*left.columns))
    return left.select("_row.*")

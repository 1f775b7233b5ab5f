"""Near copies that a fingerprint of the whole text can't reach: an exact search, in which no pair is left out.

Near copies are texts whose share of common five-word shingles is ``share`` or more.

1. All shingles have one order: those that many documents hold come last, the others go by their hashes.
   Of a text with m shingles the first m - ceil(share * m) + 1 are its keys.  Two near copies have a key in
   common, whatever the order is; putting common shingles last only keeps the groups of a key small.
2. Texts with the same shingles are linked to the one of least id, which stands for them.
3. Within each key all meet three hubs: the least id, the greatest, and the one with the fewest shingles
   before the key.  This links most copies of a large group by as many pairs as it has members.
4. Of each key whose members aren't in one component by then, all pairs across components are counted by the
   keys they share, in blocks of ``BLOCK`` members, so no key is one task.  Near copies share so many keys
   that the rest of their shingles can make up what is missing; only such pairs go on.
5. Pairs of 3 and 4 are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, passing, ship, sized, stored
from .components import components

SHINGLE, SHARE = 5, 0.8
#: Members of a block of a key's group.
BLOCK = 64
#: A shingle is common if so many of one in so many documents have it; at most so many are put last.  None of the three sets what is found.
LEAST, ONE_IN, MOST = 8, 16, 1 << 20


def shingles(text: str | None, width: int = SHINGLE) -> set:
    found = (text or "").encode().lower().split()
    return set(zip(*(found[k:] for k in range(width)))) if len(found) >= width else {tuple(found)} if found else set()


def similarity(a: str | None, b: str | None) -> float:
    """The share of common shingles; two texts without words are alike."""
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _hashed(texts: list) -> Iterator:
    """The sorted distinct shingle hashes of each text, None for one without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    known: dict = {}
    for t in texts:
        found = (t or "").encode().lower().split()
        if not found:
            yield None
            continue
        if len(known) > 1 << 17:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        width = min(SHINGLE, len(h))
        yield np.unique(_mix(sum(h[k : len(h) - width + 1 + k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1) for k in range(width))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def common_shingles(docs: DataFrame, least: int = LEAST, one_in: int = ONE_IN, most: int = MOST):
    """Sorted hashes of the shingles that come last, counted over one in ``one_in`` documents."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for h in _hashed(b.column(1).to_pylist()):
                if h is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view("i8"))], ["h"])

    ship(docs.sparkSession)
    some = _texts(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    n = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return np.sort(n.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow().column(0).to_numpy().astype("i8").view("u8"))


def keys(docs: DataFrame, share: float = SHARE, last=None) -> DataFrame:
    """doc_id, same, m, keys of each row with an id and a word: a digest and the number of its shingles, and its keys in order."""
    import numpy as np

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.array([], dtype=np.uint64) if last is None else last)

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b
        from math import ceil

        import pyarrow as pa

        last = sent.value
        for b in batches:
            ids, same, m, out = [], [], [], []
            for i, h in zip(b.column(0).to_pylist(), _hashed(b.column(1).to_pylist())):
                if h is None:
                    continue
                ids.append(i)
                same.append(blake2b(h.tobytes(), digest_size=16).digest())
                m.append(len(h))
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                    h = np.concatenate([h[~late], h[late]])
                out.append(h[: len(h) - ceil(share * len(h) - 1e-9) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(m, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "same", "m", "keys"])

    ship(spark)
    return _texts(docs).mapInArrow(run, "doc_id long, same binary, m int, keys array<long>")


def _verified(docs: DataFrame, pair: DataFrame, share: float) -> DataFrame:
    """The rows of ``pair`` (u, v) whose texts are near copies."""
    with passing(docs.sparkSession):
        return _checked(docs, stored(pair, "passage-pairs"), share)


def _checked(docs: DataFrame, pair: DataFrame, share: float) -> DataFrame:
    ids = stored(pair.select(F.col("u").alias("doc_id")).union(pair.select("v")).distinct(), "passage-ids")
    texts = stored(_texts(docs).join(sized(ids), "doc_id", "left_semi"), "passage-texts")
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            u, v, a, c = (b.column(k).to_pylist() for k in ("u", "v", "text_u", "text_v"))
            good = [k for k in range(len(u)) if similarity(a[k], c[k]) >= share]
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in good], pa.int64()), pa.array([v[k] for k in good], pa.int64())], ["u", "v"])

    ship(docs.sparkSession)
    met = pair.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v")
    return stored(met.mapInArrow(verify, "u long, v long"), "passage-links", passes=False, batch=TEXTS // 4)


def near_copies(docs: DataFrame, gone: DataFrame | None = None, share: float = SHARE, known: DataFrame | None = None) -> DataFrame:
    """(u, v) of verified near copies that span all groups of near copies among the rows of ``docs`` whose id isn't in ``gone`` (doc_id).

    Any two near copies are linked, directly or over others, be it by the links ``known`` (u, v), which aren't
    repeated.  Rows without an id or without words take no part.
    """
    # the least overlap of near copies of sizes a and b, and whether the sizes allow it
    need = lambda a, b: share / (1 + share) * (a + b) - 1e-6
    sized_alike = lambda a, b: F.least(a, b) >= share * F.greatest(a, b) - 1e-6
    ends = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    fits = lambda a, b: 1 + F.least(a["m"] - 1 - a["i"], b["m"] - 1 - b["i"]) >= need(a["m"], b["m"])

    cut = keys(docs, share, common_shingles(docs))
    cut = stored(cut if gone is None else cut.join(gone, "doc_id", "left_anti"), "passages", batch=TEXTS)
    first = stored(cut.groupBy("same").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n"), "passage-firsts")
    equal = stored(cut.select("doc_id", "same").join(sized(first), "same").filter("doc_id != v").select(F.col("doc_id").alias("u"), "v", "same").distinct(), "passage-equals")
    own = cut.join(sized(equal).select(F.col("u").alias("doc_id"), "same"), ["doc_id", "same"], "left_anti")
    rows = own.select("doc_id", "m", F.posexplode("keys").alias("i", "p"))
    shared = rows.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1").select("p")
    met = stored(rows.join(shared, "p"), "passage-keys")

    d = F.struct("doc_id", "m", "i")
    hubs = met.groupBy("p").agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.min(F.struct("i", "doc_id", "m")).alias("c"))
    hubs = hubs.select("p", F.array_distinct(F.array("lo", "hi", F.struct("c.doc_id", "c.m", "c.i"))).alias("hubs"))
    pair = met.join(hubs, "p").select(d.alias("a"), F.explode("hubs").alias("b")).filter((F.col("a.doc_id") != F.col("b.doc_id")) & fits(F.col("a"), F.col("b")))
    pair = pair.groupBy(*ends(F.col("a.doc_id"), F.col("b.doc_id"))).agg(F.count("*").alias("n"), F.min(F.least("a.m", "b.m")).alias("m"))
    near = _verified(docs, pair.filter(F.col("n") * 40 * SHARE >= F.col("m") * (1 - share)).select("u", "v"), share)

    spanned = equal.select("u", "v").unionByName(near)
    linked = spanned if known is None else spanned.unionByName(known)
    return spanned.unionByName(_verified(docs, _across(met, linked, need, sized_alike, fits, ends, share), share))


def _across(met: DataFrame, linked: DataFrame, need, sized_alike, fits, ends, share: float) -> DataFrame:
    """(u, v) of all pairs that may be near copies and aren't in one component of ``linked`` (u, v)."""
    roots = stored(components(linked), "passage-roots")
    home = met.join(sized(roots), met.doc_id == roots.node, "left").select("p", "doc_id", "m", "i", F.coalesce("root", "doc_id").alias("c"))
    mixed = home.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("p", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = stored(home.join(mixed, "p"), "passage-mixed")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = F.struct("doc_id", "m", "i", "c")
    a = left.select("p", one.alias("a"), block.alias("x"), others.alias("y"))
    b = left.select("p", one.alias("b"), block.alias("y"), others.alias("x"))
    a_, b_ = F.col("a"), F.col("b")
    pair = a.join(b, ["p", "x", "y"]).filter((F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.c") != F.col("b.c")) & sized_alike(F.col("a.m"), F.col("b.m")))
    pair = pair.groupBy(*ends(F.col("a.doc_id"), F.col("b.doc_id"))).agg(F.count("*").alias("n"), F.max(fits(a_, b_)).alias("fits"), F.min(F.least("a.m", "b.m")).alias("s"), F.max(F.greatest("a.m", "b.m")).alias("l"))
    # shingles beyond the keys: at most ceil(share * m) - 1 of either text
    rest = F.ceil(share * F.col("l") - 1e-9) - 1
    return pair.filter(F.col("fits") & (F.col("n") + rest >= need(F.col("s"), F.col("l")))).select("u", "v")

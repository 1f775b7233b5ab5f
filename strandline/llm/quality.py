"""Quality by Bradley-Terry ranking: scores learnt from preference pairs, cut at a score quantile.

A document labelled 1 is preferred to one labelled 0.  The score is linear in features of the text: what
its surface looks like, and hashed n-grams, of bytes within and across words and of whole words.  Its weights
minimise the logistic loss of feature differences over such pairs.  The cut is the quantile of the training
scores that tells the labels apart best, and scores are reported relative to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ship

#: Surface measures, and buckets for three bytes in a row, for words and for pairs of words.
SURFACE, BYTES, WORDS, PAIRS = 9, 256, 64, 64
FEATURES = SURFACE + BYTES + WORDS + PAIRS
#: How far n-grams count beside surface measures, each scaled by its spread: many small ones against few.
GRAMS = 0.25
#: At most so many labelled documents are fitted on, the first by a hash of their ids, and so many partners met by each.
SAMPLE, PARTNERS = 12_000, 8


def _shares(buckets, size: int):
    """Square roots of the buckets' shares: a vector of length one, or zeros for no n-gram."""
    import numpy as np

    return np.sqrt(np.bincount(buckets, minlength=size) / max(1, len(buckets)))


def features(text: str | None):
    """What a text looks like, whatever its language; each number grows slowly or lies between 0 and 1."""
    from zlib import crc32

    import numpy as np

    raw = (text or "").encode()
    byte = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    share = np.bincount(byte, minlength=256) / max(1, len(raw))
    found = raw.split()
    n = max(1, len(found))
    lines = raw.split(b"\n")
    upper, lower = float(share[65:91].sum()), float(share[97:123].sum())
    plain = float(share[[9, 10, 13, 32, *b".,;:'\"-()?"]].sum())
    wide = float(share[128:].sum())
    digits = float(share[48:58].sum())
    surface = [
        math.sqrt(max(0.0, 1 - upper - lower - plain - wide - digits)),  # other signs
        sum(map(bytes.__eq__, found[1:], found)) / n,
        upper / max(1e-9, upper + lower) if raw else 0.0, math.sqrt(digits), wide,
        1 - len(set(lines)) / len(lines), 1 - len(set(found)) / n, math.log1p(len(found)) / 10, math.log1p(len(raw) / n) / 5,
    ]
    three = (byte[:-2] * np.uint32(0x9E3779B1) + byte[1:-1] * np.uint32(0x85EBCA6B) + byte[2:] * np.uint32(0xC2B2AE35)) if len(byte) > 2 else byte[:0]
    three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)) % np.uint32(BYTES)
    word = np.fromiter(map(crc32, found, repeat(0)), dtype=np.uint32, count=len(found))
    pair = (word[1:] * np.uint32(0x9E3779B1) + word[:-1]) >> np.uint32(16)
    return np.concatenate([surface, _shares(three, BYTES), _shares(word % np.uint32(WORDS), WORDS), _shares(pair % np.uint32(PAIRS), PAIRS)])


@dataclass(frozen=True)
class Model:
    """score = logistic(sum of weights x features - cut); a model of no use scores 0.5 throughout."""

    weights: tuple[float, ...] = (0.0,) * FEATURES
    cut: float = 0.0

    @cached_property
    def _array(self):
        import numpy as np

        return np.array(self.weights)

    def score(self, text: str | None) -> float:
        z = float(self._array @ features(text)) - self.cut
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            xs = [features(t.as_py()).astype("<f4").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(xs, pa.binary())], ["doc_id", "quality", "x"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, quality int, x binary")


def rank(z, better, worse, ridge: float, steps: int = 12):
    """The weights that minimise the mean of log(1 + exp(-(z[better] - z[worse]) w)) and a ridge: Newton steps, each solved by conjugate gradients.

    Differences are taken between scores, so no matrix of pairs is made; sums are in the precision of ``z``.
    """
    import numpy as np

    w, m, kind = np.zeros(z.shape[1]), len(better), z.dtype
    over = lambda v: (z @ v.astype(kind)).astype(float)

    def back(pairs):
        """Sums of the pairs' values by document, then by feature."""
        return (z.T @ (np.bincount(better, pairs, len(z)) - np.bincount(worse, pairs, len(z))).astype(kind)).astype(float) / m

    for _ in range(steps):
        s = over(w)
        p = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -500, 500)))
        grad = back(p) - ridge * w
        step, r = np.zeros_like(w), grad
        d, size = r, r @ r
        for _ in range(40):
            if size <= 1e-12 * (grad @ grad) or size == 0:
                break
            t = over(d)
            h = back(p * (1 - p) * (t[better] - t[worse])) + ridge * d
            a = size / (d @ h)
            step, r = step + a * d, r - a * h
            size, old = r @ r, size
            d = r + size / old * d
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, partners: int = PARTNERS, ridge: float = 1e-3) -> Model:
    """Learn from the labelled documents outside the held-out fold (crc32 of the id modulo 3 is 1).

    Only ids choose the sample.  Null ids and labels are left out; of several labels of an id the least
    counts, of several texts the one of least hash, so the driver gets at most ``sample`` rows.  Without both
    labels there is nothing to prefer and the model stays neutral.
    """
    import numpy as np

    own = labels.filter("doc_id is not null and quality is not null").filter(crc_mod(F.col("doc_id"), 3) != 1)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    met = met.groupBy("doc_id", "quality").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
    rows = sorted(_table(met.select("doc_id", "quality", "text")).collect(), key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows])
    if len(set(y.tolist()) & {0, 1}) < 2:
        return Model()
    z = np.stack([np.frombuffer(r.x, dtype="<f4") for r in rows])
    del rows
    middle = z.mean(axis=0, dtype=float)
    z -= middle.astype("<f4")  # in place: this is the one large table of the driver
    spread = np.maximum(np.sqrt(np.einsum("ij,ij->j", z, z, dtype=float) / len(z)), 1e-3)
    spread[SURFACE:] = np.maximum(spread[SURFACE:], float(spread[SURFACE:].mean())) / GRAMS  # rare n-grams don't weigh more than common ones
    z /= spread.astype("<f4")
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pick = np.random.default_rng(7)
    many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
    a, b = np.repeat(many, partners), pick.choice(few, size=len(many) * partners)
    w = rank(z, *((a, b) if many is good else (b, a)), ridge)
    score = z @ w.astype("<f4")
    order = np.argsort(score, kind="stable")
    # rejecting the k lowest is right for their zeros and for the ones above
    right = np.concatenate([[0], np.cumsum(np.where(y[order] == 0, 1, -1))])
    k = int(np.argmax(right))
    s = score[order]
    cut = s[0] - 1 if k == 0 else s[-1] + 1e-9 if k == len(s) else (s[k - 1] + s[k]) / 2
    own_w = w / spread
    return Model(tuple(map(float, own_w)), float(cut + middle @ own_w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text scores as an empty one.

    The fold of a row without an id isn't held out.  Repeated rows stay, other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = [model.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array([int(v >= 0.5) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    ship(docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns, whatever their names.

    Rows are judged each by its text alone: null ids and repeated rows are no cases of their own, a null text
    is judged as an empty one, and an empty table stays empty.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def rate(text):
        import pyarrow as pa

        return pa.array([model.score(t.as_py()) for t in text], pa.float64())

    return docs.filter(rate(F.col("text")) >= 0.5)

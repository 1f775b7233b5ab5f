"""Token counts as delta-maintained rollups.

A rollup is a folder of immutable commits, ``batch=<id>/``, each with the additive change that a batch
makes to documents and tokens by source, language and tokenizer version.  A batch is a table of signed
rows: +1 inserts a document's count, -1 deletes it, and a revision is the old count deleted and the new
one inserted.  Totals are the sum of all commits, so they are never recomputed from documents.

Commits are idempotent: a batch's rows are added up and written by Spark's own commit protocol under the
batch's id, and a batch whose folder has its success mark is not written again.  Totals read the folders
with the mark only.  A replay, or a retry after a lost executor or driver, therefore changes nothing.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_words, _own, ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A fixed value: the pattern that cuts a text before byte pairs are merged, as published for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, sign int, tokens long"
CHANGE = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Totals by source, language and tokenizer version in one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _marks(self, batch: str) -> list[str]:
        """The folders of the batches of that name, or of that pattern, that have their success mark."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}/_SUCCESS")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def committed(self, batch: str) -> bool:
        return bool(self._marks(batch))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows (DELTA) once; False if it had been committed before.

        Null sources, languages and versions are groups like others; null counts add nothing.  An empty
        batch is committed too.  Partial sums come before the shuffle, so no group is gathered.  Batches
        are named by letters, digits, dots, dashes and underscores; ValueError for other names.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if self.committed(batch):
            return False
        change = deltas.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("documents"), F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).alias("tokens"))
        change.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """The sums of all commits; groups that came to nothing are left out.  Batches without their mark don't count."""
        parts = self._marks("*")
        rows = self.spark.read.schema(CHANGE).parquet(*parts) if parts else self.spark.createDataFrame([], CHANGE)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents != 0 or tokens != 0")


def insert(counted: DataFrame) -> DataFrame:
    return counted.select("source", "lang", "tokenizer", F.lit(1).alias("sign"), "tokens")


def delete(counted: DataFrame) -> DataFrame:
    return counted.select("source", "lang", "tokenizer", F.lit(-1).alias("sign"), "tokens")


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    return delete(old).unionByName(insert(new))


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], name: str) -> DataFrame:
    """The rows of ``docs`` (with a text) with columns tokenizer and tokens, twice: for words, and for byte pairs.

    The vocabulary, of bounded size, is broadcast from the driver, so executors need no file.  A null
    text has no tokens.  Columns of ``docs`` with the names of results or counts are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(ranks)
    keep = [c for c in docs.columns if c not in ("text", "words", "pairs", "tokenizer", "tokens")]
    counted = docs.select(*keep, count_words(F.col("text")).alias("words"), "text")
    schema = counted.drop("text").withColumn("pairs", F.lit(0).cast("long")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import tiktoken

        coder = tiktoken.Encoding("strandline", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            rest = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64())], [*rest.schema.names, "pairs"])

    each = F.inline(F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit(name).alias("tokenizer"), F.col("pairs").alias("tokens"))))
    return counted.mapInArrow(run, schema).select(*keep, each)


def fresh(spark: SparkSession) -> Rollup:
    """A rollup of its own below the session's shared folder."""
    return Rollup(spark, f"{_own(spark)}/rollup-{uuid.uuid4().hex}")

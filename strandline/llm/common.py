"""Helpers shared by the training-data operators: tables, durable intermediates, word splitting.

Durable intermediates go below ``spark.checkpoint.dir`` only.  That folder is shared by the
driver and every executor, so losing an executor never loses an intermediate.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import shared_dir, ship

__all__ = ["SPACE", "WORD", "ascii_lower", "count_words", "crc_mod", "let", "passing", "shared_dir", "ship", "sized", "stored", "sweep", "table", "words"]

#: ASCII white space, the separator of words in every contract of this package.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _own(spark: SparkSession) -> str:
    """This application's folder for intermediates.  It is swept when the driver's Python ends while Spark still runs."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/strandline/{sc.applicationId}"
    if not getattr(sc, "_strandline_swept", False):
        sc._strandline_swept = True
        atexit.register(lambda: sc._jsc and _delete(sc, path))
    return path


def sweep(spark: SparkSession) -> None:
    """Delete the intermediates of this application, once results that are read from them have been written."""
    _delete(spark.sparkContext, _own(spark))


_made: list[list[str]] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts that Python gets at a time where an operator runs at once.
TEXTS = 1000


def stored(df: DataFrame, name: str, passes: bool = True, batch: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there.

    Python gets ``batch`` rows at a time, if given: fewer where they are texts, several of which fill its memory.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_made) > (not passes):
        _made[-1 if passes else -2].append(path)
    before = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers up to which a table may be broadcast, some 40 MB.
SMALL = 1_000_000


def sized(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows``, a stored table of a few numbers a row, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` inside goes when the block ends without an error, but for what is stored with
    ``passes=False``, which belongs to the block around it."""
    _made.append([])
    try:
        yield
        for path in _made[-1]:
            _delete(spark.sparkContext, path)
    finally:
        _made.pop()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words a text has, without making an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n

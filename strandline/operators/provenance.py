"""Fingerprints, and recomputing only what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by bars; a null part reads 'None'."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)).cast("binary"), 256)


def latest(records: DataFrame, keys: Sequence[str] = ("stage", "output_key"), by: str = "updated_at") -> DataFrame:
    """The last record of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col("fingerprint")))
    return records.withColumn("_n", n).filter("_n = 1").drop("_n")


def status(outputs: DataFrame, recorded: DataFrame, keys: Sequence[str], expected: str = "fingerprint") -> DataFrame:
    """``outputs`` with provenance: current, stale or missing."""
    r = recorded.select(*keys, F.col("fingerprint").alias("_recorded"))
    state = F.when(F.col("_recorded").isNull(), "missing").when(F.col("_recorded") == F.col(expected), "current").otherwise("stale")
    return outputs.join(r, list(keys), "left").withColumn("provenance", state).drop("_recorded")


def pending(outputs: DataFrame, recorded: DataFrame, keys: Sequence[str], expected: str = "fingerprint") -> DataFrame:
    """Outputs that aren't recorded with their present fingerprint: what is left to do."""
    return outputs.join(recorded.select(*keys, F.col("fingerprint").alias(expected)).distinct(), [*keys, expected], "left_anti")


def upsert(recorded: DataFrame, done: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records after ``done``, records that it replaces, for the quarantine)."""
    columns = [*keys, "fingerprint"]
    old = recorded.join(done.select(*keys), list(keys), "left_semi").join(done.select(*columns), columns, "left_anti")
    rest = recorded.join(done.select(*keys), list(keys), "left_anti")
    return rest.select(*columns).unionByName(done.select(*columns)), old


def quarantined(old: DataFrame, reason: str) -> DataFrame:
    """Replaced rows with the reason and time; they are appended to the quarantine and never deleted."""
    from ..functions.text import reason_slug

    return old.withColumn("reason", reason_slug(F.lit(reason))).withColumn("at", F.current_timestamp())

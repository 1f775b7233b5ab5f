"""JSON records: provenance, gates, events, checkpoints, the model manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, GATE, MANIFEST, PROVENANCE


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines are read as nulls and so never count as current."""
    return spark.read.schema(PROVENANCE).option("mode", "PERMISSIVE").json(path).filter("fingerprint is not null")


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GATE).option("mode", "PERMISSIVE").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).option("mode", "PERMISSIVE").json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream: each JSON line once."""
    return spark.readStream.schema(EVENT).option("mode", "PERMISSIVE").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """platform, role, repo, revision, directory, filename of the model manifest."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))
    roles = whole.select(F.explode("m").alias("platform", "roles")).select("platform", F.explode("roles").alias("role", "spec"))
    return roles.select("platform", "role", "spec.*")


def usable_checkpoints(checkpoints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(media_id, chunk_no, content) with a verdict (errors) for each -> those to be used again.

    A checkpoint that is blank on purpose is valid; one with text but without sound cues isn't.
    """
    from ..functions.text import strip

    c = checkpoints.join(verdicts.select("media_id", "chunk_no", "errors"), ["media_id", "chunk_no"], "left")
    sound = F.coalesce(F.size("errors") == 0, F.lit(False))
    return c.filter((strip(F.coalesce("content", F.lit(""))) == "") | sound).drop("errors")


def pending_chunks(chunks: DataFrame, usable: DataFrame) -> DataFrame:
    return chunks.join(usable.select("media_id", "chunk_no"), ["media_id", "chunk_no"], "left_anti")

"""Media files and what is known about them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key

EXTENSIONS = ("avi", "mp4", "mkv", "mov", "webm")


def media_files(spark: SparkSession, folder: str, ordered: str = "name") -> DataFrame:
    """Top-level media of a folder: path, name, length, mtime.  The content column is pruned, so no file is read.

    ``ordered``: "name" for NFKC and case-folded names, "path" for plain paths.  A missing folder raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("mtime"))
    kept = kept.filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*EXTENSIONS))
    if ordered == "path":
        return kept.orderBy("path")
    return kept.withColumn("_key", name_key(F.col("name"))).orderBy("_key", "path").drop("_key")


def stem(name: Column) -> Column:
    """The name without its last extension: what names a medium's sidecars."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def stem_collisions(media: DataFrame) -> DataFrame:
    """Stems that several media share, whose sidecars would overwrite each other."""
    return media.groupBy(stem(F.col("name")).alias("stem")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names")).filter("n > 1")


def durations(media: DataFrame, probe: Callable[[str], float]) -> DataFrame:
    """``media`` with duration_ms; ``probe`` gives seconds for a path and runs on the executors, in Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(duration_ms=[round(probe(p) * 1000) for p in pdf["path"]])

    from pyspark.sql import types as T

    return media.mapInPandas(run, T.StructType([*media.schema.fields, T.StructField("duration_ms", T.LongType())]))


def stream_inventory(probed: DataFrame, column: str = "probe_json") -> DataFrame:
    """The ``streams`` of probe output as an array of maps; malformed output gives an empty one."""
    parsed = F.from_json(column, "streams array<map<string,string>>", {"mode": "PERMISSIVE"})
    return probed.withColumn("streams", F.coalesce(parsed["streams"], F.array().cast("array<map<string,string>>")))


def inventory(media: DataFrame, sidecars: DataFrame, source: str = "ja", target: str = "zh-Hans") -> DataFrame:
    """One row: videos, bytes, source_complete, target_complete.  ``sidecars``: stem, lang, length."""
    done = sidecars.filter("length > 0").groupBy("stem").agg(F.max(F.col("lang") == source).alias("_s"), F.max(F.col("lang") == target).alias("_t"))
    m = media.withColumn("stem", stem(F.col("name"))).join(done, "stem", "left")
    return m.agg(
        F.count("*").alias("videos"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.count_if(F.coalesce("_s", F.lit(False))).alias("source_complete"), F.count_if(F.coalesce("_t", F.lit(False))).alias("target_complete"),
    )

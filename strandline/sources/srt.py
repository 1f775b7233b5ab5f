"""Subtitle sidecars as cue tables, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from ..functions import timecode


def parse(files: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """Rows with a sidecar's ``content`` -> one row a cue: the other columns, pos, idx, timing, start_ms, end_ms, text, error.

    ``error`` says why a block is no cue (null for a sound one); its file as a whole is then malformed.  A
    byte order mark and any newline are accepted; an empty file gives no rows, or with ``strict`` one error.
    """
    keep = [c for c in files.columns if c != content]
    body = X.strip(F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), r"^\x{feff}", ""), r"\r\n?", "\n"))
    rows = files.select(*keep, body.alias("_body"))
    if not strict:
        rows = rows.filter("_body != ''")
    blocks = rows.select(*keep, F.posexplode(F.split("_body", r"\n{2,}")).alias("pos", "_block"))
    lines = F.split("_block", "\n")
    b = blocks.select(*keep, F.col("pos") + 1, lines.alias("_lines"), "_block").toDF(*keep, "pos", "_lines", "_block")
    number = X.strip(F.get("_lines", F.lit(0))).try_cast("int")
    timing = X.strip(F.get("_lines", F.lit(1)))
    text = X.strip(F.array_join(F.slice("_lines", 3, F.greatest(F.size("_lines"), F.lit(1))), "\n"))
    side = lambda k: timecode.parse_timestamp(F.get(F.split(timing, " --> "), F.lit(k)))
    error = (
        F.when(F.col("_block") == "", "empty subtitle file")
        .when(F.size("_lines") < 3, F.concat(F.lit("malformed block: "), F.left("_block", F.lit(80))))
        .when(number.isNull(), F.concat(F.lit("malformed index: "), F.get("_lines", F.lit(0))))
        .when(~timing.rlike(timecode.TIMING), F.concat(F.lit("malformed timing: "), timing))
    )
    return b.select(*keep, "pos", number.alias("idx"), timing.alias("timing"), side(0).alias("start_ms"), side(1).alias("end_ms"), text.alias("text"), error.alias("error"))


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Sidecars below a path: path, media_id (name without language), lang, and the columns of ``parse``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    files = files.select("path", F.regexp_extract(name, r"^(.*)\.([^.]+)\.srt$", 1).alias("media_id"), F.regexp_extract(name, r"^(.*)\.([^.]+)\.srt$", 2).alias("lang"), "content")
    return parse(files, strict=strict)


def block(idx: Column, timing: Column, text: Column) -> Column:
    return F.concat_ws("\n", idx.cast("string"), timing, X.strip(text))


def serialize(cues: DataFrame, part: Sequence[str], order: str = "idx") -> DataFrame:
    """part, content: blocks joined by blank lines, with one newline at the end."""
    one = F.struct(F.col(order).alias("o"), block(F.col("idx"), F.col("timing"), F.col("text")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["b"]), "\n\n")
    return cues.groupBy(*part).agg(F.concat(body, F.lit("\n")).alias("content"))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        import glob
        import os

        return [_Part(p) for p in sorted(glob.glob(os.path.join(self.folder, "*.srt")))]

    def read(self, partition):
        import os

        with open(partition.path, encoding="utf-8-sig", newline="") as f:
            yield os.path.basename(partition.path), f.read()


class SrtFiles(DataSource):
    """``spark.read.format("srt").load(folder)``: name, content of local sidecars, for ``parse``; one partition a file.

    For folders on a cluster store use ``read``, which goes through Spark's own file sources.
    """

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

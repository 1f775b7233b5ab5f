"""Sinks.  Tables go through Spark's commit protocol; single sidecars are written aside and renamed."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship


#: A fixed value: the ending of what isn't whole yet.
PARTIAL = ".partial"
#: The two logs of a run.
PEOPLES_LOG, PROGRAMS_LOG = "pipeline.log", "events.jsonl"


def atomic_write(path: str | os.PathLike, text: str) -> None:
    """The text appears whole or not at all: it is flushed to a file of its own beside the target, which then takes its name."""
    folder, name = os.path.split(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, aside = tempfile.mkstemp(prefix=f"{name}.", suffix=PARTIAL, dir=folder)
    try:
        with open(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(aside, path)
    except BaseException:
        os.unlink(aside)
        raise


def write_sidecars(files: DataFrame, folder: str) -> None:
    """(name, content) -> one file each, written by the executors; ``folder`` is a mount that they share."""

    def write(rows: Iterable) -> None:
        for r in rows:
            atomic_write(os.path.join(folder, r["name"]), r["content"])

    ship(files.sparkSession)
    files.select("name", "content").foreachPartition(write)


def write_report(report: DataFrame, path: str) -> None:
    """status, name, detail as tab-separated lines without a header, by medium; part after part, in their order."""
    rows = report.repartitionByRange("media_id").sortWithinPartitions("media_id", "tier") if "tier" in report.columns else report
    rows.select("status", "name", "detail").write.mode("overwrite").csv(path, sep="\t", header=False, quote="")


def write_failures(names: DataFrame, path: str, column: str = "name") -> None:
    """One name a line; nothing but an empty folder when there are none."""
    names.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_warnings(clips: DataFrame, path: str) -> None:
    """Decode warnings by fingerprint, the stream inventory first."""
    lines = F.concat_ws("\n", F.to_json("streams"), "warnings")
    clips.select("fingerprint", lines.alias("value")).write.mode("overwrite").partitionBy("fingerprint").text(path)


def append_quarantine(old: DataFrame, path: str) -> None:
    """Replaced rows, with reason and time, are added and never removed."""
    old.write.mode("append").parquet(path)


def clean_partials(root: str | os.PathLike, execute: bool = False) -> list[str]:
    """What was left unfinished below a folder, deleted if ``execute``."""
    left = [os.path.join(d, name) for d, _, names in os.walk(root) for name in names if name.endswith(PARTIAL)]
    for path in left if execute else ():
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)
    return sorted(left)


def log_event(folder: str | os.PathLike, event: str, message: str) -> None:
    """One line for people and one for programs, each appended by a single write."""
    os.makedirs(folder, exist_ok=True)
    at = datetime.now().isoformat(sep=" ", timespec="seconds")
    lines = {PEOPLES_LOG: f"[{at}] {message}", PROGRAMS_LOG: json.dumps({"event": event, "timestamp": at, "message": message}, ensure_ascii=False)}
    for name, line in lines.items():
        handle = os.open(os.path.join(folder, name), os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
        try:
            os.write(handle, f"{line}\n".encode())
        finally:
            os.close(handle)

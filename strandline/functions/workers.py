"""What executors share with the driver: this package, and a folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where it isn't installed: the session serves a zip of it, once."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    home = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(), "strandline_workers.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent).as_posix())
    sc.addPyFile(name)
    sc._strandline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and Spark is local."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
    return sc.getCheckpointDir()

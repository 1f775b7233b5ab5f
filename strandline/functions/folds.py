"""Folds that gather rows.

Appending to an array copies it, so a fold that appends ``n`` times copies n * n / 2 entries.  Gathered in
chunks, an entry is copied within its chunk and then with it, which is n * CHUNK / 2 and a 4096th of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def nothing(kind: str) -> Column:
    """The gatherer of entries of a type that has none yet."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("part"))


def push(gatherer: Column, entry: Column) -> Column:
    full, part = gatherer["full"], gatherer["part"]
    room = F.size(part) < CHUNK
    return F.struct(F.when(room, full).otherwise(F.array_append(full, part)).alias("full"), F.when(room, F.array_append(part, entry)).otherwise(F.array(entry)).alias("part"))


def gathered(gatherer: Column) -> Column:
    """The array of all entries in the order in which they came."""
    return F.flatten(F.array_append(gatherer["full"], gatherer["part"]))

"""Times of cues: seconds, milliseconds and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = r"(\d{2,}):(\d{2}):(\d{2}),(\d{3})"
TIMING = rf"^{SIDE} --> {SIDE}$"


def milliseconds(seconds: Column) -> Column:
    """Half-even, never negative."""
    return F.greatest(F.rint(seconds * 1000).cast("long"), F.lit(0))


def timestamp(seconds: Column) -> Column:
    return timestamp_of_ms(milliseconds(seconds))


def timestamp_of_ms(ms: Column) -> Column:
    part = lambda size, of: F.floor(ms / size) % of if of else F.floor(ms / size)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), (ms % 1000).cast("long"))


def parse_timestamp(text: Column) -> Column:
    """Milliseconds of one side of a timing; null where it isn't one."""
    bare = F.regexp_extract(text, r"^\s*(\d+:\d{2}:\d{2},\d{3})\s*$", 1)
    field = lambda k: F.regexp_extract(bare, r"^(\d+):(\d{2}):(\d{2}),(\d{3})$", k).cast("long")
    return F.when(bare != "", ((field(1) * 60 + field(2)) * 60 + field(3)) * 1000 + field(4))


def timing(start: Column, end: Column) -> Column:
    return F.concat(timestamp(start), F.lit(" --> "), timestamp(end))


def number_or(value: Column, default: float) -> Column:
    """A number, or the default where it is absent or isn't one."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def logprob(value: Column) -> Column:
    return number_or(value, -99.0)


def no_speech_prob(value: Column) -> Column:
    return number_or(value, 1.0)

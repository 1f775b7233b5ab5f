"""Text measures and rules as Column functions.

Classes are written out so that Java and RE2 read them alike: ``\\w`` and ``\\s`` are ASCII in Java.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Script, Settings

#: The inside of a class of all white space, and of word characters.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
KANA_CJK = r"\x{3040}-\x{30ff}\x{4e00}-\x{9fff}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def squash(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(text: Column) -> Column:
    """Nothing but white space; cheaper than stripping, as it stops at the first other character."""
    return ~text.rlike(f"[^{SPACE}]")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def longest_run(compact: Column) -> Column:
    """Length of the longest run of one character, 1 where none repeats."""
    runs = F.regexp_extract_all(compact, F.lit(r"(?s)((.)\2+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(1))


def first_match(text: Column, pattern: str) -> Column:
    """The first match, empty if there is none."""
    return F.regexp_extract(text, pattern, 0)


def zlib_ratio(text: Column) -> Column:
    """UTF-8 bytes divided by bytes after zlib at its default level.  Spark has no such function; Arrow batches go to Python."""

    @F.pandas_udf("double")
    def ratio(texts):
        import zlib

        import pandas as pd

        raw = [None if t is None else t.encode() for t in texts]
        return pd.Series([None if b is None else len(b) / max(1, len(zlib.compress(b))) for b in raw], dtype="float64")

    return ratio(text)


def quality_error(text: Column, script: Script = Script(), ratio: Column | None = None) -> Column:
    """The first rule that a text breaks, as a message; null if none.

    ``ratio`` is the compression ratio of the squashed text, by default computed; pass a null literal
    to leave that rule out and stay within the JVM.
    """
    # Only texts of 40 characters and more can break the rule on compression, so no others go to Python.
    packed = zlib_ratio(F.when(F.length(squash(text)) >= 40, squash(text))) if ratio is None else ratio

    def judge(x: Column) -> Column:
        compact, packed, n = x["compact"], x["packed"], F.length(x["compact"])
        # A run of twelve is sought before the longest is measured, which few texts need.
        repeated = let(longest_run(compact), lambda run: F.concat(F.lit("single character repeated "), run.cast("string"), F.lit(" times")))
        alien = first_match(compact, script.alien_run)
        return (
            F.when(compact == "", F.lit("empty cue"))
            .when(compact.rlike(r"(?s)(.)\1{11}"), repeated)
            .when(compact.rlike(script.alien_run), F.concat(F.lit("unexpected Latin text in Japanese transcript: '"), alien, F.lit("'")))
            .when((n >= 40) & (packed > 2.8), F.concat(F.lit("highly repetitive text (compression ratio "), F.format_string("%.1f", packed), F.lit(")")))
            .when(n > 120, F.concat(F.lit("implausibly long cue ("), n.cast("string"), F.lit(" characters)")))
        )

    return let(F.struct(squash(text).alias("compact"), packed.alias("packed")), judge)


def repetition_root(text: Column, widest: int = 8) -> Column:
    """The shortest unit of 1 to ``widest`` characters that repeats to the whole lower-cased word text."""


    def root(compact: Column) -> Column:
        n = F.length(compact)
        out = F.when(n == 0, compact)
        for w in range(1, widest + 1):  # a chain of when stops at the first width that fits
            unit = F.left(compact, F.lit(w))
            # a text repeats with period w if it equals itself moved by w
            out = out.when((n >= w) & (n % w == 0) & compact.endswith(unit) & (F.left(compact, n - w) == F.substring(compact, F.lit(w + 1), n)), unit)
        return out.otherwise(compact)

    return let(F.lower(F.regexp_replace(text, f"[^{WORD}{KANA_CJK}]+", "")), root)


def quoted(text: Column) -> Column:
    """A text in quotes, as Python's ``repr`` writes it for texts of printable characters and ASCII control characters.

    Apostrophes are the quotes unless the text has some and no double quotes; backslashes, line breaks, tabs and
    the quote itself are escaped, other control characters by their code.
    """
    both = text.contains("'") & ~text.contains('"')
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit({9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\x{code:02x}")))
    return F.when(both, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def punctuation_only(text: Column) -> Column:
    return ~text.rlike(f"[{WORD}{KANA_CJK}]")


def stock_phrase(text: Column, phrases: Sequence[str], drop: str = rf"[。.!！?？{SPACE}]") -> Column:
    return F.regexp_replace(text, drop, "").isin(*phrases)


def compact_length(text: Column) -> Column:
    """Letters and digits only, the underscore not counted."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def has(text: Column, inside: str) -> Column:
    return text.rlike(f"[{inside}]")


def review_reasons(source: Column, candidate: Column, settings: Settings = Settings()) -> Column:
    """Why a translation needs review: an array of labels in a fixed order, empty if it doesn't."""
    s = settings.script
    n, ratio = compact_length(source), F.try_divide(compact_length(candidate).cast("double"), compact_length(source))
    short, long = ratio < settings.translation_review_min_length_ratio, ratio > settings.translation_review_max_length_ratio
    bare = strip(source)
    depends = bare.rlike(f"(?:{'|'.join(s.final_particles)})$") | source.rlike("|".join(s.context_words))
    label = lambda test, name: F.when(test, F.lit(name))
    return F.array_compact(
        F.array(
            label(candidate == s.unclear, "unclear fallback"),
            label(bare == strip(candidate), "unchanged source"),
            label(has(candidate, s.left_over), "Japanese script"),
            label(has(source, s.left_over + s.ideograph) & ~has(candidate, s.ideograph), "no Chinese script"),
            label((n >= 4) & short, "unusually short"),
            label((n >= 4) & ~short & long, "unusually long"),
            label((F.length(bare) <= 18) & depends, "context-sensitive fragment"),
        )
    )


def replacement_is_safe(source: Column, replacement: Column, script: Script = Script()) -> Column:
    bare = strip(replacement)
    wrong = has(bare, script.left_over) | (has(source, script.left_over + script.ideograph) & ~has(bare, script.ideograph))
    return (bare != "") & (bare != strip(source)) & ~wrong


def parse_numbered(response: Column, count: Column) -> Column:
    """Items ``[1] ..`` to ``[count] ..`` of a marked answer; the last of equal numbers counts; null unless all are there."""
    pattern = rf"(?ms)^[{SPACE}]*\[(\d+)\][{SPACE}]*(.*?)(?=^[{SPACE}]*\[\d+\][{SPACE}]*|\z)"
    marks = F.arrays_zip(
        F.regexp_extract_all(response, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(response, F.lit(pattern), F.lit(2)).alias("t")
    )
    items = F.transform(marks, lambda m: F.struct(m["n"].try_cast("int").alias("n"), strip(m["t"]).alias("t")))
    items = F.filter(items, lambda m: (m["n"] >= 1) & (m["n"] <= count) & (m["t"] != ""))
    last = lambda k: F.try_element_at(F.filter(items, lambda m: m["n"] == k), F.lit(-1))["t"]
    found = F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), last)).otherwise(F.array().cast("array<string>"))
    return F.when(~F.exists(found, lambda t: t.isNull()), found)


def reason_slug(reason: Column, default: str = "rejected") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(reason), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def name_key(name: Column) -> Column:
    """NFKC, then full case folding: the order of media names.  Neither is built into Spark."""

    @F.pandas_udf("string")
    def key(names):
        import unicodedata

        return names.map(lambda n: None if n is None else unicodedata.normalize("NFKC", n).casefold())

    return key(name)


def similarity(first: Column, second: Column) -> Column:
    """Ratcliff-Obershelp ratio with the standard library's rules.  Not symmetric: ``first`` is the primary text."""

    @F.pandas_udf("double")
    def ratio(a, b):
        from difflib import SequenceMatcher

        import pandas as pd

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio(first, second)

"""Small tables with everything that may go wrong in one, and plain ways to say what is in them."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "the long and winding text of many words that goes on " * 3000

#: Nulls in each column, empty and blank texts, a very long one, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "b", 57),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "b", 57),
    (3, None, "en", "a", None),
    (4, "", None, "a", 0),
    (5, " \t\n ", "de", None, 4),
    (6, "zwei Wörter", "de", "c", 11),
    (None, "no id at all but words enough for shingles", "en", "a", 42),
    (None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Ünï cödé 😀 ÀÉ ñandú été façade straße мир 世界", "xx", "c", 40),
    (9, "x", "en", "b", 1),
]


def documents(spark, rows=ODD, clash=()):
    """The rows as a table; ``clash`` names further columns that an operator might use itself."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit("clash") for c in clash}) if clash else d


def ascii_words(text):
    return (text or "").encode().lower().split()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)

"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """The records a line reader yields: breaks are \\n, \\r and \\r\\n; no record follows a final break."""
    lines = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)


def word_pieces(line: Column) -> Column:
    """Lower-cased line split at runs of non-word (ASCII) characters, keeping an empty last piece."""
    return F.split(F.lower(line), r"\W+", -1)


def drop_trailing_empty(pieces: Column) -> Column:
    """Drop empty pieces at the end, but keep the one piece of a line without any separator.

    Runs of separators are one match, so there is one empty piece at either end at most.
    """
    size = F.size(pieces)
    kept = (
        F.when(size == 1, 1)
        .when(F.element_at(pieces, -1) != "", size)
        .when((size == 2) & (F.element_at(pieces, 1) == ""), 0)
        .otherwise(size - 1)
    )
    return F.slice(pieces, F.lit(1), kept)


def to_doubles(text: Column, sep: str) -> Column:
    """``1.0 2.5`` -> array of doubles; a piece that is no number fails the query."""
    return F.transform(F.split(text, sep), lambda piece: piece.cast("double"))

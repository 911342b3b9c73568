"""Word count and keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import drop_trailing_empty, word_pieces


def word_count(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(word, cnt)`` over lines. The empty token before a leading separator counts as a word."""
    pieces = lines.select(word_pieces(F.col(col)).alias("pieces"))
    words = pieces.select(F.explode(drop_trailing_empty(F.col("pieces"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def grep(df: DataFrame, col: str, keyword: str) -> DataFrame:
    """Rows whose text contains the literal keyword, case-sensitively."""
    return df.filter(F.col(col).contains(keyword))

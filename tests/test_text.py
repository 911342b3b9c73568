from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import rows
from tidewheel.functions.text import drop_trailing_empty, split_lines, word_pieces
from tidewheel.operators.text import grep, word_count
from tidewheel.sources.text import lines_of, spread


def tokens(spark, *lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    df = df.select("i", word_pieces(F.col("value")).alias("p"))
    return [r.t for r in df.select("i", drop_trailing_empty(F.col("p")).alias("t")).orderBy("i").collect()]


def test_tokens_keep_a_leading_but_no_trailing_empty_piece(spark):
    got = tokens(spark, "", "!!!", "Hello, World", "  lead", "trail. ", "a_b-c9", "x", ". . a . .")
    assert got == [[""], [], ["hello", "world"], ["", "lead"], ["trail"], ["a_b", "c9"], ["x"], ["", "a"]]


def test_words_are_ascii(spark):
    assert tokens(spark, "été", "naïve Ärger") == [["", "t"], ["na", "ve", "rger"]]


def test_word_count(spark, partitions):
    lines = ["The cat", "the dog; THE END", "", "!!!", " x"]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    want = Counter(["the", "cat", "the", "dog", "the", "end", "", "", "x"])
    assert dict(rows(word_count(df))) == dict(want)


def test_one_word_holding_most_rows_is_reduced_before_the_shuffle(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("value"))
    counted = word_count(df)
    assert dict(rows(counted))["hot"] == 13333
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_lines(spark):
    texts = ["a\nb\r\nc\rd", "x\n", "\n", "", "a\n\nb", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.l for r in df.select(split_lines(F.col("text")).alias("l")).collect()]
    assert got == [["a", "b", "c", "d"], ["x"], [""], [], ["a", "", "b"], ["one"]]
    assert rows(lines_of(df, "text")) == sorted([("a",), ("b",), ("c",), ("d",), ("x",), ("",), ("a",), ("",), ("b",), ("one",)])


def test_grep_is_literal_and_case_sensitive(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("A.B",), ("xa.by",)], "value string")
    assert rows(grep(df, "value", "a.b")) == [("a.b",), ("xa.by",)]


def test_spread_leaves_inputs_with_enough_splits_alone(spark):
    slots = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).repartition(1), "id").rdd.getNumPartitions() == slots
    many = spark.range(0, 100, 1, slots * 2)
    assert spread(many, "id") is many

from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ODD, measured, odd_documents
from tidewheel.llm import rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measurements_are_those_of_brute_force(spark):
    texts = [r[1] for r in ODD] + [
        "a b c d e f g h a b c d e f g h",
        "a b c d e f g h i a b c d e f g h",
        "x " * 100,
        "p q r s t u v w x y z " + "1 2 3 4 5 6 7 8 9 " * 3 + "p q r s t u v w",
        "tab\tand\x0bother\x0cgaps\rhere\n#*$ |",
        "same\nsame\n same\n\n",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for row in rules.ledger(rows).collect():
        found = row["ledger"]["measured"]
        assert tuple(found[n] for n in NAMES) == measured(row["text"]), row["text"][:80]


def test_bits_follow_the_rules_and_policies_read_them(spark):
    rows = rules.ledger(odd_documents(spark))
    names = [rule.name for rule in rules.RULES]
    for row in rows.select("text", "ledger", rules.kept(F.col("ledger")["bits"], 1).alias("kept")).collect():
        words, _, _, _, repeated = measured(row["text"])
        bits = row["ledger"]["bits"]
        assert bool(bits >> names.index("too_few_words") & 1) == (words < 20)
        assert bool(bits >> names.index("repeated_windows") & 1) == (100 * repeated > 30 * words)
        assert row["kept"] == (words >= 20 and 100 * repeated <= 30 * words)


def test_policy_keeps_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "w%d " % i * 1 + " ".join(f"v{j}x{i}" for j in range(25))) for i in (1, 1, 2)], "doc_id int, text string")
    docs = docs.withColumn("ledger", F.lit(7))
    kept = rules.apply_policy(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 3 and kept.select("ledger").distinct().first()[0] == 7


def test_ablation_is_that_of_single_policies(spark):
    bits = [0, 0, 1, 2, 3, 4, 4, 5, 64, 127]
    entries = spark.createDataFrame([((b,),) for b in bits], "ledger struct<bits:long>")
    mask, allowed = rules.POLICIES[rules.CURRENT]
    found = {r["rule"]: r for r in rules.ablation(entries).collect()}
    for place, rule in enumerate(rules.RULES):
        bit = 1 << place
        row = found[rule.name]
        assert row["failed"] == sum(bool(b & bit) for b in bits)
        assert row["failed_alone"] == sum(b & mask == bit for b in bits)
        assert row["kept_without"] == sum((b & mask & ~bit).bit_count() <= allowed for b in bits)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert rules.apply_policy(none).collect() == []
    assert all(r["failed"] == r["kept_without"] == 0 for r in rules.ablation(rules.ledger(none)).collect())

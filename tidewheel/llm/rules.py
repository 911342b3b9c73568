"""Quality rules: a ledger of failure bits and measurements, and policies over it.

Every rule is evaluated once per document. The ledger keeps one bit per failed rule
beside the measurements, so that another policy or an ablation needs no second look at
the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, let, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails where ``left * times > right * per``, or ``left < below``, of the measurements."""

    name: str
    left: str
    times: int = 1
    right: str | None = None
    per: int = 0
    below: int | None = None

    def failed(self, measured: Column) -> Column:
        value = measured[self.left]
        if self.below is not None:
            return value < self.below
        return value * self.times > measured[self.right] * self.per


#: A rule's place is its bit. New rules go to the end; a place is never used again.
RULES = (
    Rule("too_few_words", "n_words", below=20),
    Rule("repeated_windows", "n_repeat_words", 100, "n_words", 30),
    Rule("symbols", "n_symbols", 100, "n_words", 25),
    Rule("repeated_lines", "n_dup_lines", 100, "n_lines", 60),
    Rule("shouting", "n_capitals", 100, "word_chars", 50),
    Rule("long_words", "word_chars", 1, "n_words", 25),
    Rule("short_words", "n_words", 2, "word_chars", 1),
)


def mask_of(*names: str, rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules."""
    places = {rule.name: place for place, rule in enumerate(rules)}
    return sum(1 << places[name] for name in set(names))


#: By version: the rules that count, and how many of them a document may fail.
POLICIES = {
    1: (mask_of("too_few_words", "repeated_windows"), 0),
    2: (mask_of(*(rule.name for rule in RULES)), 0),
}
CURRENT = 2


def _repeated(words: Column, width: int) -> Column:
    """Words in windows of ``width`` words that the text has at least twice.

    Windows are compared by 64-bit hashes of their words' hashes. Only a text with equal
    hashes is sorted; a word in several such windows counts once.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def doubled(rows: Column) -> Column:
            def as_neighbour(row, i):
                before = F.get(rows, i - 1)["h"]
                after = F.get(rows, i + 1)["h"]
                return F.coalesce(before == row["h"], F.lit(False)) | F.coalesce(after == row["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, as_neighbour), lambda row: row["i"]))

        def spread(places: Column) -> Column:
            steps = F.transform(
                places,
                lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))),
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

        return let(let(ordered, doubled), spread)

    def windows(hashes: Column) -> Column:
        starts = F.when(
            F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))

    return let(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows),
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(
            F.lit(0).cast("long")
        ),
    )


def measurements(text: Column) -> Column:
    """A struct of long values about a whole text; all 0 for a null or empty one."""
    text = F.coalesce(text, F.lit(""))

    def chars(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        ]

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    words = words_of(text)
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda total, one: total + F.length(one)).alias("word_chars"),
            _repeated(w, WINDOW).alias("n_repeat_words"),
        ),
    )
    return let(
        F.struct(counted.alias("w"), let(lines, lambda x: F.struct(*of_lines(x))).alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            chars(r"[^#*$%&|<>]+").alias("n_symbols"),
            chars("[^A-Z]+").alias("n_capitals"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def ledger(
    docs: DataFrame, text: str = "text", name: str = "ledger", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``docs`` with a struct ``name``: ``bits`` (long, a 1 for each failed rule) and the measurements.

    A null text is measured as an empty one. Repeated rows are measured one by one, other
    columns stay as they are, and a column called ``name`` is replaced. No rows, no result.
    """
    if len(rules) > 63:
        raise ValueError("a ledger has room for 63 rules")

    def entry(measured: Column) -> Column:
        bits = F.lit(0).cast("long")
        for place, rule in enumerate(rules):
            bits = bits + F.when(rule.failed(measured), F.lit(1 << place)).otherwise(F.lit(0)).cast("long")
        return F.struct(bits.alias("bits"), measured.alias("measured"))

    return docs.withColumn(name, let(measurements(F.col(text)), entry))


def kept(bits: Column, version: int = CURRENT) -> Column:
    """Whether a policy keeps a document with these failure bits."""
    mask, allowed = POLICIES[version]
    return F.bit_count(bits.bitwiseAND(F.lit(mask).cast("long"))) <= allowed


def apply_policy(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    name = "ledger"
    while name in docs.columns:
        name += "_"
    return ledger(docs, text, name).where(kept(F.col(name)["bits"], version)).drop(name)


def ablation(
    entries: DataFrame, version: int = CURRENT, name: str = "ledger", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """For each rule of a policy: documents failing it, failing only it, and kept without it.

    Works on the counts of equal failure bits, never on the documents again. Returns rule,
    failed, failed_alone, kept_without (long), one row per rule of the policy; all 0 for an
    empty ledger.
    """
    mask, allowed = POLICIES[version]
    patterns = entries.groupBy(F.col(name)["bits"].alias("bits")).agg(F.count("*").alias("n"))
    places = [(rule.name, 1 << place) for place, rule in enumerate(rules) if mask >> place & 1]
    spread = patterns.select(
        "n",
        F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"),
        F.explode(
            F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in places))
        ).alias("r"),
    )
    failed = F.col("bits").bitwiseAND(F.col("r")["bit"]) != 0
    others = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r")["bit"])))
    zero = F.lit(0).cast("long")
    totals = spread.groupBy(F.col("r")["rule"].alias("rule")).agg(
        F.sum(F.when(failed, F.col("n")).otherwise(zero)).alias("failed"),
        F.sum(F.when(failed & (others == 0), F.col("n")).otherwise(zero)).alias("failed_alone"),
        F.sum(F.when(others <= allowed, F.col("n")).otherwise(zero)).alias("kept_without"),
    )
    names = entries.sparkSession.createDataFrame([(n,) for n, _ in places], "rule string")
    return names.join(totals, "rule", "left").na.fill(0)

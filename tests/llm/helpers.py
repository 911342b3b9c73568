"""Brute-force counterparts and small inputs for the tests of this folder."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty and blank texts, repeated rows, a null id, ties, marks of every kind, a long text.
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, None, 4),
    (4, "one two three", "en", "b", 13),
    (4, "one two three", "en", "b", 13),
    (None, "one two three", "en", None, 13),
    (5, "One Two THREE", "en", "b", 13),
    (6, "a b c d e f g h " * 40, "en", "a", 640),
    (7, " ".join(f"word{i}" for i in range(30000)), "en", "c", None),
    (8, "É x   y <|im_end|> #*$%&|<>", "fr", "", 20),
    (9, "line one\nline one\n\nline two\nline one", "en", "a", 30),
    (10, "x" * 50000, "en", "a", 50000),
]


def odd_documents(spark):
    """The odd rows, with columns that are called like the operators' own."""
    rows = spark.createDataFrame(ODD, DOCS)
    extra = {c: "clash" for c in ("shard", "slot", "ledger", "size", "print", "score", "ids", "copies", "rank", "target")}
    from pyspark.sql import functions as F

    return rows.withColumns({c: F.lit(v) for c, v in extra.items()})


def measured(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def fingerprint(text, shingle=3):
    """SimHash, bit by bit."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    counts = [0] * 64
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    for one in shingles:
        value = xxhash.xxh64_intdigest(one.encode(), 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def groups(prints, distance=2):
    """Component of each key: the smallest key reachable over prints that differ in few bits."""
    keys = list(prints)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}

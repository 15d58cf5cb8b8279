"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule.  A policy is a versioned mask of the rules that it enforces, so that a change of
policy, or an ablation, is bitwise work over the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP

#: Words in a window whose repetition counts.
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurement columns; ``bit`` is the rule's place for good."""

    name: str
    bit: int
    fails: Callable[[], Column]


RULES = [
    Rule("few_words", 0, lambda: F.col("n_words") < 20),
    Rule("repeated_words", 1, lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", 2, lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("duplicate_lines", 3, lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    Rule("long_words", 4, lambda: F.col("word_chars") > 25 * F.col("n_words")),
]

#: Rules by policy version.  "base" holds the two rules that no policy may drop.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words"),
}


def mask(version: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[version])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, however often it is used, and only where the row needs it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text.

    Each window is a hash over its words' hashes.  Only a text with a repeated window goes on:
    its windows are sorted by hash, equal neighbours are the repeated ones, and their places in
    order give the covered words, each window adding what lies before the next one.
    """
    w = REPEAT_WINDOW

    def covered(pairs: Column) -> Column:
        repeated = F.filter(
            pairs,
            lambda e, k: (e["h"] == F.get(pairs, k - 1)["h"]).eqNullSafe(F.lit(True)) | (e["h"] == F.get(pairs, k + 1)["h"]).eqNullSafe(F.lit(True)),
        )
        places = F.sort_array(F.transform(repeated, lambda e: e["i"]))
        return _bound(
            places,
            lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.lit(w), F.coalesce(F.get(at, k + 1) - i, F.lit(w)))),
                F.lit(0).cast("long"),
                lambda total, gained: total + gained,
            ),
        )

    def of_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _bound(pairs, covered)).otherwise(F.lit(0).cast("long"))

    def of_hashes(h: Column) -> Column:
        return _bound(F.transform(F.sequence(F.lit(1), F.size(h) - (w - 1)), lambda i: F.xxhash64(F.slice(h, i, w))), of_windows)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) > w, _bound(hashes, of_hashes)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long).

    A null or empty text measures zero everywhere.  Lines are split at \\n; a line without a
    word does not count.  Each text is handled inside its row, in time n log n of its words.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(value, WORD_GAP), lambda x: x != "")
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumns({"_words": words, "_lines": lines}).select(
        *(docs[c] for c in docs.columns),
        F.size("_words").cast("long").alias("n_words"),
        (F.char_length(F.regexp_replace(value, WORD_GAP, ""))).cast("long").alias("word_chars"),
        (F.char_length(value) - F.char_length(F.translate(value, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (long) for every document, with its other columns.

    Columns of ``docs`` named like a measurement or ``fail_bits`` are replaced.
    """
    clean = docs.drop(*(c for c in docs.columns if c.lower() in {*MEASURES, "fail_bits", "_words", "_lines"}))
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    return measure(clean, text).withColumn("fail_bits", bits)


def verdict(bits: Column, version: str) -> Column:
    """True where a document fails no rule that the policy enforces."""
    return bits.bitwiseAND(F.lit(mask(version))) == 0


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    Documents are counted by their masked bits first, at most one row per combination of rules,
    so nothing but counts is shuffled.
    """
    m = mask(version)
    combos = entries.select(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rules = entries.sparkSession.createDataFrame([(r.name, 1 << r.bit) for r in RULES if m >> r.bit & 1], "rule string, rule_bit long")
    hit = F.col("bits").bitwiseAND(F.col("rule_bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("rule_bit")))
    flags = combos.withColumn("rule_pair", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("rule_bit")) for r in RULES if m >> r.bit & 1))))
    flags = flags.select("bits", "n", "rule_pair.rule", "rule_pair.rule_bit")
    counts = flags.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
    return rules.select("rule").join(counts, "rule", "left").na.fill(0, ["failed", "failed_alone", "kept_without"])


def keep(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    own = docs.columns
    name = "text"
    renamed = docs.toDF(*(f"c{i}" for i in range(len(own))))
    entries = ledger(renamed, f"c{own.index(name)}")
    return entries.filter(verdict(F.col("fail_bits"), version)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)))

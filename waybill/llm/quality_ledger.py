"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger holds the measurements of a text and one integer whose bit
i is set where rule i fails. Policies are named, versioned masks over these bits: applying one, or
asking what a rule removes, never reads a text again. Everything is a built-in function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WINDOW = 5  # words
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"[A-Z]{2,}"




def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the measurements of every text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines`` (equal to an earlier
    one), ``n_repeat_words`` (words in 5-word windows found twice or more in the text, the first
    included) and ``n_capitals`` (runs of two or more capitals A-Z).

    Windows are compared by a 64-bit hash of their words' hashes. Windows that occur twice are
    found by sorting (hash, place), only in texts that have one. Null text counts as empty: all
    zero. Each row gives a row, repeated ones and null ids too; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = r"[\x20\x09-\x0D]+"
    trimmed = F.trim("text", F.lit(BLANKS))
    split = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, blank)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
    )
    counted = split.select(
        "id", "n_symbols", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    measures = [
        "id", "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines",
    ]
    # slice: as many windows as fit; a shorter text has none
    n_windows = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    windows = counted.select(
        *measures,
        F.transform(
            F.slice("hashes", F.lit(1), n_windows),
            lambda h, i: F.xxhash64(h, *[F.get(F.col("hashes"), i + k) for k in range(1, WINDOW)]),
        ).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = windows.select(
        *measures,
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"),
    )
    twice = placed.select(
        *measures,
        F.sort_array(F.transform(
            F.filter("placed", lambda x, i: (
                F.coalesce(F.get(F.col("placed"), i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(F.col("placed"), i + 1)["h"] == x["h"], F.lit(False))
            )),
            lambda x: x["i"],
        )).alias("at"),
    )
    # each window adds its words up to the next one's first
    added = F.transform(
        "at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(WINDOW))).cast("long")
    )
    zero = F.lit(0).cast("long")
    repeated = F.coalesce(F.aggregate(added, zero, lambda a, x: a + x), zero).alias("n_repeat_words")
    # A condition on the result would be pushed down to the text, with every step above written into it again
    # and again. It can't be pushed through a generator (the outer kind, which infers no filter of its own).
    return twice.select(*measures, repeated).select(F.inline_outer(F.array(F.struct(*measures, "n_repeat_words"))))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, an SQL condition on the measurements, is true."""

    name: str
    fails: str


# Bit i of a ledger belongs to rule i: new rules are put at the end, none is ever moved.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "2 * n_capitals > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
POLICIES = {
    "base_v1": ("few_words", "repeated_words"),
    "clean_v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals"),
    "clean_v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "short_words", "long_words"),
    # without repeated lines, which some good documents have: license lines, refrains
    "clean_v3": ("few_words", "repeated_words", "symbols", "capitals", "short_words", "long_words"),
}


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[n] for n in set(names))


def ledger(measures: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measurements with ``failed``, a bit for each rule. A condition that is null does not fail."""
    if len(rules) > 62:
        raise ValueError("a ledger has room for 62 rules")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bit = F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bits.bitwiseOR(bit)
    return measures.withColumn("failed", bits)


def rejected(policy: str | Sequence[str], failed: str = "failed") -> Column:
    """Whether a ledger row breaks a rule of the policy."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(failed).bitwiseAND(F.lit(mask_of(names))) != 0


def ablations(rows: DataFrame, policies: dict[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: what the rule and the policy remove.

    ``n_failed`` rows break the rule, ``n_only`` break no other rule of the policy (they would stay
    without it), ``n_removed`` break any rule of the policy, ``other_rules`` are the bits of all other rules
    that the rule's rows break. The rows are first counted by their bits, so the
    rest works on at most 2^rules rows.
    """
    by_bits = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [
        F.struct(
            F.lit(name).alias("policy"), F.lit(rule).alias("rule"),
            F.lit(mask_of(names, rules)).cast("long").alias("mask"), F.lit(mask_of([rule], rules)).cast("long").alias("bit"),
        )
        for name, names in policies.items() for rule in names
    ]
    bit, mask = F.col("bit"), F.col("mask")
    hit, of_policy = F.col("failed").bitwiseAND(bit), F.col("failed").bitwiseAND(mask)
    zero = F.lit(0)
    return (
        by_bits.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
        .groupBy("policy", "rule").agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(zero)).alias("n_failed"),
            F.sum(F.when(of_policy == bit, F.col("n")).otherwise(zero)).alias("n_only"),
            F.sum(F.when(of_policy != 0, F.col("n")).otherwise(zero)).alias("n_removed"),
            F.coalesce(
                F.bit_or(F.when(hit != 0, F.col("failed").bitwiseAND(F.bitwise_not(bit)))), zero.cast("long")
            ).alias("other_rules"),
        )
    )

"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps each failure as a bit beside the
measurements. A policy is a versioned mask over those bits, so changing a policy, comparing two, or
asking what one rule costs reads the ledger and never the texts again.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.

Edge cases: a null or empty text has no words and fails ``few_words``; texts of fewer than three
words have no three-word window; a document's ledger row depends on that document alone, so
repeated rows get equal rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once: an outer column named in a lambda may be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def _repeated_words(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in ``words``."""

    def positions(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs: Column) -> Column:
            same = lambda other, x: F.coalesce(F.get(pairs, other)["h"] == x["h"], F.lit(False))
            starts = F.transform(F.filter(pairs, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, repeated))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, positions))


def measurements(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and the raw counts that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    measured = docs.select(
        "doc_id",
        *carry,
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("long").alias("n_digits"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return measured.select("doc_id", *carry, "w.*", "word_chars", "n_symbols", "n_digits", "l.*")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurements; ``bit`` is its place in the mask, never reused."""

    name: str
    bit: int
    fails: Callable[[], Column]


RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("short_words", 2, lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", 3, lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("symbols", 4, lambda: 4 * F.col("n_symbols") > F.col("word_chars")),
    Rule("digits", 5, lambda: 2 * F.col("n_digits") > F.col("word_chars")),
    Rule("repeated_lines", 6, lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
DEFAULT = Policy("2", tuple(r.name for r in RULES))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, ``failures`` (bit ``b`` set: the rule with that bit failed) and the measurements."""
    measured = measurements(docs, carry)
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits)


def verdict(policy: Policy, failures: Column | None = None) -> Column:
    """Whether a ledger row passes ``policy``."""
    failures = F.col("failures") if failures is None else failures
    return failures.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def passing(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs``, all columns, whose document passes ``policy``."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    return ledger(whole, carry=("__row",)).filter(verdict(policy)).select("__row.*")


def compare(rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """Documents kept by both, by one only and by neither, from the ledger alone."""
    a, b = verdict(old), verdict(new)
    return rows.agg(
        F.count_if(a & b).alias("kept_by_both"),
        F.count_if(a & ~b).alias("newly_rejected"),
        F.count_if(~a & b).alias("newly_kept"),
        F.count_if(~a & ~b).alias("rejected_by_both"),
    )


def ablation(rows: DataFrame, policy: Policy = DEFAULT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of ``policy``: how many documents fail it, and how many only it rejects."""
    masked = F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long"))
    used = [r for r in rules if policy.mask >> r.bit & 1]
    counted = rows.groupBy(masked.alias("m")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("mask")) for r in used]))
    return (
        counted.select("m", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.mask")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("m") == F.col("r.mask"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        )
    )

"""Quality rules as a bitmask ledger. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, with_columns_last, words_of

#: Words of the windows whose repetition within a text is counted.
REPEAT_WINDOW = 8

#: Rules by bit: name -> condition over the measurements under which a document fails it. The order of
#: the bits is part of every ledger that was written; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "few_letters": "5 * (n_punctuation + n_digits) > 2 * word_chars",
    "digits": "4 * n_digits > word_chars",
    "many_words": "n_words > 100000",
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines", "few_letters", "digits"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_digits")


def bits(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, window: int) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in the array."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        twin = lambda x, k: F.get(ordered, k + 1)["h"].eqNullSafe(x["h"]) | ((k > 0) & F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"].eqNullSafe(x["h"]))
        return _let(F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"])), covered)

    def over(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, repeated))

    def windows(each: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(each) - window)
        return _let(F.transform(starts, lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(window)])), over)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(hashed, windows)).cast("bigint")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the measurements of MEASURES as long columns.

    A null text counts as an empty one; columns of ``docs`` named like an output give way to it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.trim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    less = lambda pattern: F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _repeat_words(words, REPEAT_WINDOW).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    out = with_columns_last(docs, [*MEASURES]) if text not in MEASURES else docs
    own = _let(words_of(whole), of)
    by_line = _let(lines, of_lines)
    in_words, in_lines = (next(n for k in range(1, 1000) if (n := "_" * k + name) not in docs.columns) for name in ("words", "lines"))
    out = out.withColumn(in_words, own).withColumn(in_lines, by_line)
    return out.withColumns(
        {
            "n_words": F.col(in_words)["n_words"],
            "word_chars": F.col(in_words)["word_chars"],
            "n_symbols": less(r"[#*$%&|<>]+").cast("bigint"),
            "n_dup_lines": F.col(in_lines)["n_dup_lines"],
            "n_repeat_words": F.col(in_words)["n_repeat_words"],
            "n_lines": F.col(in_lines)["n_lines"],
            "n_punctuation": less(r"[!-/:-@\[-`{-~]+").cast("bigint"),
            "n_digits": less(r"[0-9]+").cast("bigint"),
        }
    ).drop(in_words, in_lines)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every rule evaluated once: ``measured`` and ``failures``, a long with a bit for each failed rule. Rows are judged one by one, so
    repeated rows, null ids and ties get equal answers; a null text has no words. Columns of the results' names are replaced, all
    others pass; an empty table gives an empty table."""
    out = measured(docs, text)
    mask = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES.values()):
        mask = mask.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("failures", mask)


def verdict(policy: str = "v1", failures: str = "failures") -> Column:
    """True where none of the policy's rules failed. Reads the ledger only, never a text."""
    return F.col(failures).bitwiseAND(F.lit(bits(POLICIES[policy])).cast("bigint")) == 0


def kept_without(policy: str = "v1", failures: str = "failures") -> Column:
    """The bit of the rule whose omission alone would keep a row that the policy rejects; 0 where there is none."""
    hit = F.col(failures).bitwiseAND(F.lit(bits(POLICIES[policy])).cast("bigint"))
    return F.when(F.bit_count(hit) == 1, hit).otherwise(F.lit(0).cast("bigint"))


def ablation(failures: DataFrame, policies: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule: documents the policy rejects, those the rule fails, and those that would be
    kept if this rule alone were left out. One pass over the masks, pre-aggregated by mask value."""
    named = POLICIES if policies is None else policies
    counts = failures.groupBy("failures").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(bits(rs)).cast("bigint").alias("mask"), F.lit(bits([r])).cast("bigint").alias("bit")) for p, rs in named.items() for r in rs]
    each = counts.withColumn("case", F.explode(F.array(*rows))).select("failures", "n", "case.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("policy", "rule").agg(
        count(hit != 0).alias("n_rejected"),
        count(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_kept_without"),
    )


__all__ = ["MEASURES", "POLICIES", "RULES", "SPACES", "ablation", "bits", "kept_without", "ledger", "measured", "verdict"]

"""Quality rules: one table of thresholds, compiled into one Spark projection.

Counts are made once per text from its words and lines; a rule is a row of ``RULES``
(measure, comparison, limit), and the verdict is their conjunction. Everything is a
built-in expression. Repeated three-word windows are found by sorting the windows'
hashes with their positions, words being compared wherever hashes meet.

Defined results: a null or blank text has zero of everything and fails the base; ratios
of an empty denominator are null and then break no rule; repeated rows keep a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import GAPS, documents

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

# Frequent function words of the languages at hand, lower case.
STOP_WORDS = {
    "de": ("das", "der", "die", "ein", "für", "in", "ist", "mit", "nicht", "und", "von"),
    "en": ("and", "for", "in", "is", "of", "on", "that", "the", "to", "with"),
    "es": ("con", "de", "del", "el", "en", "la", "los", "para", "por", "que", "una", "y"),
    "fr": ("dans", "de", "des", "est", "et", "la", "le", "les", "pour", "que", "qui", "une"),
}


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure op limit`` holds."""

    name: str
    measure: str
    op: str
    limit: float


RULES = (
    Rule("short_words", "word_chars / n_words", "<", 2.0),
    Rule("long_words", "word_chars / n_words", ">", 20.0),
    Rule("symbols", "n_symbols / n_words", ">", 0.1),
    Rule("shouting", "n_bangs / n_words", ">", 0.5),
    Rule("stop_words", "n_stop_words", "<", 2),
    Rule("repeated_lines", "n_dup_lines / n_lines", ">", 0.3),
    Rule("one_line_of_many_words", "n_words / n_lines", ">", 20_000),
)


def breaks(rule: Rule) -> Column:
    """The rule as a condition; false where the measure is not defined."""
    left = F.expr(rule.measure.replace(" / ", " * 1.0D / nullif(") +
                  (", 0)" if " / " in rule.measure else ""))
    limit = F.lit(rule.limit)
    return F.coalesce(left < limit if rule.op == "<" else left > limit, F.lit(False))


def stop_list() -> list[str]:
    words = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return words + [w.capitalize() for w in words]


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text."""
    text = F.coalesce("text", F.lit(""))
    body = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    base = documents(df, id_col, text_col).select(
        "doc_id", F.when(body == "", none).otherwise(F.split(body, GAPS)).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    n, w = F.size("w"), F.col("w")
    windows = F.transform(F.sequence(F.lit(0), n - 3),
                          lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    hashed = base.select(
        "doc_id", "w", "lines", F.array_join("w", "").alias("joined"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"))
    kind = "array<struct<h:bigint,i:int>>"
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("h")) < F.size("h")
    counted = hashed.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.translate("joined", SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        (F.length("joined") - F.length(F.replace("joined", F.lit("!"), F.lit("")))).cast("long")
        .alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, stop_list())))).cast("long")
        .alias("n_stop_words"),
        F.when(some, placed).otherwise(F.array().cast(kind)).alias("s"))
    s = F.col("s")

    def same(e, other):
        def at(p):
            return F.struct(w[p], w[p + 1], w[p + 2])
        return F.coalesce((other["h"] == e["h"]) & (at(e["i"]) == at(other["i"])), F.lit(False))

    again = F.filter(s, lambda e, k: same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1)))
    covered = F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    return counted.withColumn("n_repeat_words",
                              F.size(F.array_distinct(covered)).cast("long")).drop("w", "s")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the broken rules."""
    m = measures(df, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.name)) for r in rules]))
    kept = ~failed
    for r in rules:
        kept = kept & ~breaks(r)
    return m.withColumns({"base_failed": failed, "kept": kept, "broken_rules": broken})

"""Quality rules: a threshold table compiled into Spark projections over each text.

Everything is built-in expressions on one row: no shuffle, no join, no user function. The text is split once;
later projections read the arrays. Repeated five-word windows are found by 64-bit fingerprints inside one text (for
20,000 words a collision has a chance of 1 in 10^11); only texts with a repeat sort their fingerprints.

The stop words are those of the languages in use. A long text in another language breaks that rule; give its words as `stop_words`,
or thresholds without the rule.

Edge cases: a null or empty text has no words, fails the base rules and gets zero counts. Rows are judged one by
one, so repeated rows, null or equal ids give one verdict each. Columns of the input are kept by `keep_good` and
are never read by name except for the text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WHITE_SPACE, let, split_words

WINDOW = 5

# Frequent function words of the languages in use.
STOP_WORDS = (
    "the be to of and that have with in is it for was on as are this "
    "le la les de des du et un une est que qui dans en pour "
    "der die das und zu den von mit ist ein eine nicht ich sie es "
    "el los las y que del por con una se"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document of at least `least_words` words and `least_lines` lines fails the rule if `measure` is below `low` or above `high`.
    A few words or lines say nothing about a ratio: short clean texts may lack stop words or repeat a heading."""

    rule: str
    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0
    least_lines: int = 0

    def broken(self, measures: dict[str, Column]) -> Column:
        value, broken = measures[self.measure], F.lit(False)
        if self.low is not None:
            broken = broken | (value < self.low)
        if self.high is not None:
            broken = broken | (value > self.high)
        for count, least in (("n_words", self.least_words), ("n_lines", self.least_lines)):
            if least:
                broken = broken & (F.col(count) >= least)
        return broken


THRESHOLDS = (
    Threshold("word length", "mean_word_length", low=2.0, high=15.0),
    Threshold("symbols", "symbol_ratio", high=0.1),
    Threshold("stop words", "stop_word_ratio", low=0.01, least_words=50),
    Threshold("duplicate lines", "duplicate_line_ratio", high=0.3, least_lines=5),
    Threshold("exclamation marks", "exclamation_ratio", high=0.3),
)


def _shingle_hashes(words: Column, n_words: Column) -> Column:
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    return F.transform(F.sequence(F.lit(0), n_words - WINDOW), window)


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur at least twice, by sorting one text's window fingerprints."""
    ordered = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))

    def repeated_starts(windows: Column) -> Column:
        same = lambda i, j: F.get(windows, i)["h"].eqNullSafe(F.get(windows, j)["h"])
        twice = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(windows, i)["i"]))

    # Windows overlap: each start adds the words up to the next start, at most a whole window.
    def covered(at: Column) -> Column:
        gap = lambda i: F.least(F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(WINDOW)), F.lit(WINDOW))
        gaps = F.transform(F.sequence(F.lit(0), F.size(at) - 1), gap)
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    return let(let(ordered, repeated_starts), covered)


def measured(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Counts of every text, beside the carried columns in the struct `row`."""
    # Sentence starts count too; naming all forms is cheaper than lower-casing every word.
    stop_forms = sorted({form for w in stop_words for form in (w, w.capitalize(), w.upper())})
    value = F.coalesce(F.col("row")[text], F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text])]).alias("row"))
    split = rows.select(
        "row",
        F.monotonically_increasing_id().alias("below"),
        split_words(value, WHITE_SPACE).alias("words"),
        F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words, lines = F.col("words"), F.col("lines")
    counted = split.select(
        "row",
        "below",
        "words",
        F.size(words).alias("n_words"),
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.char_length(F.regexp_replace(value, WHITE_SPACE, "")).alias("word_chars"),
        F.regexp_count(value, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(value, F.lit("!")).alias("n_exclamations"),
        F.size(F.filter(words, lambda w: w.isin(stop_forms))).alias("n_stop_words"),
        F.when(F.size(words) > WINDOW, _shingle_hashes(words, F.size(words))).alias("hashes"),
    )
    n_words = F.col("n_words")
    has_repeat = F.size(F.array_distinct("hashes")) < n_words - WINDOW + 1
    repeated = F.when((n_words > WINDOW) & has_repeat, _repeated_words(F.col("hashes"))).otherwise(0)
    # Row numbers are not pushed through: a filter on a count stays above the split, where `words` is a column. Pushed
    # below, it would split the text again for every word. The upper number keeps `kept` above all counts.
    firm = lambda c: F.when(F.col("below") >= 0, c).cast("long")
    return counted.select(
        "row",
        F.monotonically_increasing_id().alias("above"),
        *[firm(F.col(c)).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        firm(repeated).alias("n_repeat_words"),
        "n_lines",
        "n_exclamations",
        "n_stop_words",
    )


def verdict(thresholds: Sequence[Threshold] = THRESHOLDS) -> list[Column]:
    """`base_failed`, `failed_rules` and `kept` as columns over `measured`."""
    n_words = F.col("n_words")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    measures = {
        "mean_word_length": share(F.col("word_chars"), n_words),
        "symbol_ratio": share(F.col("n_symbols"), n_words),
        "stop_word_ratio": share(F.col("n_stop_words"), n_words),
        "duplicate_line_ratio": share(F.col("n_dup_lines"), F.col("n_lines")),
        "exclamation_ratio": share(F.col("n_exclamations"), n_words),
    }
    base_failed = (n_words < 10) | (F.col("n_repeat_words") * 100 > n_words * 20)
    failed = [F.when(t.broken(measures), F.lit(t.rule)) for t in thresholds]
    kept = ~base_failed & (F.col("above") >= 0)
    for t in thresholds:
        kept = kept & ~t.broken(measures)
    return [
        base_failed.alias("base_failed"),
        F.array_compact(F.array(*failed)).alias("failed_rules") if failed else F.array().cast("array<string>").alias("failed_rules"),
        kept.alias("kept"),
    ]


def quality_report(
    documents: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS, doc_id: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Per document: id, the counts, the rules it breaks and whether it is kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured(documents, text, [doc_id], stop_words).select(F.col("row")[doc_id].alias(doc_id), *counts, *verdict(thresholds))


def keep_good(documents: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The documents that pass, with their columns."""
    return measured(documents, text, documents.columns, stop_words).select("row", *verdict(thresholds)).where("kept").select("row.*")

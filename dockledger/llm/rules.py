"""Quality rules in a short-circuit cascade, ordered by rejections per cost.

Built-in functions only: each measure is a column expression over one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.session import shared_folder

# White space between words, symbols, window of repeated words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Rows of the sample that orders the rules: the first with a fitting hash of the text.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 16


def _text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column = "text") -> Column:
    return F.array_remove(F.split(_text(text), SPACE), "")


def word_chars(text: str | Column = "text") -> Column:
    return F.char_length(F.regexp_replace(_text(text), SPACE, "")).cast("long")


def symbols(text: str | Column = "text") -> Column:
    return (F.char_length(_text(text)) - F.char_length(F.translate(_text(text), SYMBOLS, ""))).cast("long")


def lines(text: str | Column = "text") -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(_text(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicates(items: Column) -> Column:
    return (F.size(items) - F.size(F.array_distinct(items))).cast("long")


def windows(items: Column, size: int = WINDOW) -> Column:
    """A 64-bit hash of each run of ``size`` items; an empty array if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(items) - (size - 1))
    return F.when(
        F.size(items) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(items, i, size)))
    ).otherwise(F.array().cast("array<bigint>"))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A repeated window is told by its 64-bit hash. Windows are sorted only in texts that
    repeat one; sorting keeps the work near linear in the text's length.
    Columns called like the new ones are replaced. A null text counts as empty.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*[n for n in names if n.lower() != text.lower()])
    # The caller's columns are one struct meanwhile, so that no name can clash.
    step = docs.select(
        F.struct("*").alias("__row"), F.col(text).alias("__text"),
        words(text).alias("__words"), lines(text).alias("__lines"),
    )
    step = step.select("*", windows(F.col("__words")).alias("__windows"))
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    tagged = F.transform(F.col("__windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.select(
        "*", F.when(repeats, F.array_sort(tagged)).alias("__sorted")
    )
    # Neighbours with equal hashes; arrays are read by position, so the sorted array must be a column.
    pairs = F.arrays_zip(
        F.slice("__sorted", 1, F.size("__sorted") - 1).alias("a"),
        F.slice("__sorted", 2, F.size("__sorted") - 1).alias("b"),
    )
    twice = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    starts = F.sort_array(
        F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))
    )
    step = step.select("*", F.when(F.col("__sorted").isNotNull(), starts).alias("__starts"))
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct(
            (i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n")
        ),
        lambda s: s["n"].cast("long"),
    )
    counts = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        word_chars("__text").alias("word_chars"),
        symbols("__text").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        duplicates(F.col("__lines")).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # A generator: a filter on a count, pushed through plain projections, would repeat all of the above.
    return step.select("__row", F.inline(F.array(counts))).select("__row.*", *names)


@dataclass(frozen=True)
class Rule:
    """A condition that rejects a text, over the measures it names."""

    name: str
    needs: tuple[str, ...]
    rejects: Column
    cost: float = 0.0
    rejected: float = 0.0

    @property
    def gain(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def default_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("few_words", ("n_words",), c("n_words") < 20),
        Rule("repeats", ("n_words", "n_repeat_words"), 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", ("n_words", "n_symbols"), 10 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", ("n_lines", "n_dup_lines"), 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule(
            "word_length", ("n_words", "word_chars"),
            (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        ),
    ]


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> list[Rule]:
    """Time each rule on a sample and count what it rejects; best rejections per second first.

    The sample is at most SAMPLE_ROWS rows, one in SAMPLE_SHARE by a hash of the text, read only as
    far as needed. It sets the order alone: a text is rejected if any rule rejects it.
    """
    shared_folder(docs.sparkSession)
    sample = (
        docs.select(F.col(text).alias("text"))
        .where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0).limit(SAMPLE_ROWS).checkpoint()
    )
    measured = with_counts(sample)
    out = []
    for rule in rules:
        needed = measured.select(*rule.needs).select(F.coalesce(rule.rejects, F.lit(False)).alias("r"))
        start = time.perf_counter()
        n, hit = needed.agg(F.count(F.lit(1)), F.count_if("r")).first()
        out.append(replace(rule, cost=time.perf_counter() - start, rejected=hit / n if n else 0.0))
    return sorted(out, key=lambda r: (-r.gain, r.name))


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does. Later
    rules are not evaluated for a rejected row."""
    chain: Column | None = None
    for rule in rules:
        chain = F.when(rule.rejects, rule.name) if chain is None else chain.when(rule.rejects, rule.name)
    return F.lit(None).cast("string") if chain is None else chain


def cascade(
    docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, text: str = "text",
    rejected_by: str = "rejected_by",
) -> DataFrame:
    """Add the counts of each text and the rule that rejects it, null for texts to keep.

    Rows with nulls elsewhere are judged alike; an empty or null text has no words. Repeated rows are
    judged each. An empty table gives an empty result.
    """
    ordered = estimate(docs, rules(), text)
    counted = with_counts(docs.drop(rejected_by), text)
    return counted.withColumn(rejected_by, first_rejection(ordered))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document, whether it fails the base rules, and the verdict."""
    out = cascade(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )

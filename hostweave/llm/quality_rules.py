"""Quality rules as a short-circuit cascade, in SQL expressions only.

Every text is described by counts of its words, lines and repetitions. A text that fails the base rule is out. The other
rules are timed and counted on a sample, ordered by rejections per second, and tried in that order until one rejects;
the order changes the cost and never the verdict.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged each; an empty table
gives no rows and leaves the rules in the order they were given. Only the id and text columns are read, so further
columns may have any names.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows on which costs and rejections are estimated.
SAMPLE_ROWS = 2_000
# How often each of them is looked at, and the least that a rule is taken to cost.
TIMES, LEAST_SECONDS = 10, 1e-3
WINDOW_WORDS = 8
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# A word that the next one repeats.
DOUBLED = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for texts to leave out; it may use the columns of ``describe`` and the text."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once per row."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW_WORDS words found twice or more in the text."""

    def covered(marks: Column) -> Column:
        # marks: (hash, start) of all windows in order of hash, so equal ones are neighbours
        same = lambda i, j: F.get(marks, i)["h"] == F.get(marks, j)["h"]
        doubled = F.filter(marks, lambda m, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        starts = F.array_sort(F.transform(doubled, lambda m: m["at"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n")),
            lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW_WORDS), at - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def counted(hashes: Column) -> Column:
        marks = F.array_sort(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(marks, covered))

    def windows(each: Column) -> Column:
        last = F.size(each) - WINDOW_WORDS
        return F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(each, i, F.lit(WINDOW_WORDS))))

    many = F.size(words) >= WINDOW_WORDS
    # xxhash64 of 64 bits: two windows of one text are taken for equal by accident about once in 1e11 texts
    return F.when(many, bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), counted)).otherwise(F.lit(0))


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, text, counts): what the rules look at."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = texts.withColumns(
        {
            "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
            "lines": F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    return split.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Lenient rules for prose in any language that puts spaces between words."""
    text, n = F.col("text"), F.col("n_words")
    lines_like = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return [
        Rule("word_length", ~(F.col("word_chars") / n).between(2, 16)),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 6 * F.col("n_lines")),
        Rule("doubled_words", 10 * lines_like(DOUBLED) > 3 * n),
        Rule("bullets", 10 * lines_like(r"(?m)^[ \t]*[-*•●]") > 9 * F.col("n_lines")),
        Rule("cut_lines", 10 * lines_like(r"(?m)(?:\.\.\.|…)[ \t]*$") > 3 * F.col("n_lines")),
        Rule("letters", 10 * lines_like(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?=$|[\x20\x09-\x0D])") > 4 * n),
        Rule("digits", 10 * lines_like(r"[0-9]") > 3 * F.col("word_chars")),
        Rule("long_run", text.rlike(r"[^\x20\x09-\x0D]{1000}")),
        Rule("filler", F.contains(F.lower(text), F.lit("lorem ipsum"))),
    ]


def estimate(documents: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS, repeats: int = 2) -> list[Estimate]:
    """Seconds and share of rejections of each rule on up to ``rows`` rows that pass the base rule, best order first."""
    total = documents.count()
    if not total:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    part = documents.select("doc_id", "text").sample(fraction=min(1.0, 1.2 * rows / total), seed=7).limit(rows)
    sample = describe(part).where(~base_failed()).persist()
    try:
        n = max(1, sample.count())
        # every row several times, so that a rule's work is more than starting a job, which a rule without work tells
        again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

        def timed(rejects: Column) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(repeats):
                began = time.perf_counter()
                hits = again.agg(F.count_if(rejects)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        timed(F.col("n_words") < 0)  # the first jobs take longer
        nothing = timed(F.col("n_words") < 0)[0]
        found = []
        for rule in rules:
            seconds, hits = timed(rule.rejects)
            found.append(Estimate(rule, max(seconds - nothing, LEAST_SECONDS), hits / TIMES / n))
    finally:
        sample.unpersist()
    # rules that reject nothing in the sample go last, the cheap ones first
    return sorted(found, key=lambda e: (-e.rank, e.seconds))


def judge(documents: DataFrame, rules: Sequence[Rule] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of every row of documents, whether the base rule failed, and the verdict of the cascade."""
    rules = standard_rules() if rules is None else list(rules)
    order = [e.rule for e in estimate(documents, rules, rows)]
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in order:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    return (
        describe(documents)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", verdict.otherwise(F.lit(True)))
        .drop("text", "n_lines")
    )

"""Operator 3, quality rules with risk-controlled cutoffs. DataFrame functions only.

Each rule is a ratio that is high in poor texts. For every stratum (language),
rule and cutoff of a grid, the labelled good documents (quality 1) that the
cutoff would reject are counted. A cutoff is admitted if the exact binomial
tail P(Bin(n, a) <= rejected) is at most ``delta`` divided by the number of all
(stratum, rule, cutoff) tests, with ``a`` the stratum's limit divided by the
number of rules: with probability 1 - delta, no stratum loses more than
``limit`` of its good documents to all rules together. The strictest admitted
cutoff of each rule is applied; a rule without one does nothing in the stratum.

Defined results: null text has no words and fails the base rule; null lang is
the stratum ''; without labels no rule but the base applies; a document with
several labels is good if one of them says so; repeated rows each get a result.
Three-word windows of one text are told apart by their 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import BLANKS, stage

MIN_WORDS = 50
#: rule -> cutoffs in ascending order, strictest first
GRID = {
    "symbols": [0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4],
    "dup_lines": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "repeats": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "odd_length": [0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0],
}
USUAL_LENGTH = 5.0  # letters in a word of ordinary prose


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` in three-word windows found twice or more."""
    def covered(h: Column) -> Column:
        # windows side by side with an equal one in the order of their hashes
        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(F.sequence(F.lit(0), last), lambda k: (F.get(s, k)["h"] == F.coalesce(F.get(s, k - 1)["h"], F.bitwise_not(F.get(s, k)["h"])))
                            | (F.get(s, k)["h"] == F.coalesce(F.get(s, k + 1)["h"], F.bitwise_not(F.get(s, k)["h"]))))
            return F.sort_array(F.transform(twin, lambda k: F.get(s, k)["i"]))

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # a window covers three words, or those up to the next window's start
        return _let(_let(ordered, places), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    hashes = F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
    return F.when(F.size(w) < 4, 0).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the rules' ratios of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    found = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), _let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"))
    return found.select("doc_id", "stratum", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def _ratio(rule: str) -> Column:
    over = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    if rule in over:
        a, b = over[rule]
        return F.col(a) / F.greatest(F.col(b), F.lit(1))
    return F.abs(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) - USUAL_LENGTH)


def _exceeded(rule: str) -> Column:
    """How many of the rule's cutoffs a document is above."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in GRID[rule]]), lambda c: _ratio(rule) > c))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), summed term by term in logarithms."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda s: s["sum"])


def thresholds(measured: DataFrame, labels: DataFrame, limit: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, and for each rule its cutoff or null), one row per stratum."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    held = measured.join(good, measured["doc_id"] == good["_id"], "left_semi").where(~base_failed())
    over = F.array(*[F.struct(F.lit(r).alias("rule"), _exceeded(r).alias("over")) for r in GRID])
    # how many cutoffs each document exceeds; few rows for each stratum
    hist = held.select("stratum", F.inline(over)).groupBy("stratum", "rule", "over").agg(F.count("*").alias("n"))
    reject = hist.where("over > 0").select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.col("over") - 1)).alias("step"), "n") \
        .groupBy("stratum", "rule", "step").agg(F.sum("n").alias("k"))
    size = hist.where(F.col("rule") == next(iter(GRID))).groupBy("stratum").agg(F.sum("n").alias("n"))
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for r, cuts in GRID.items() for i, c in enumerate(cuts)])
    tests = size.select("stratum", "n", F.inline(grid)).join(reject, ["stratum", "rule", "step"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    count = measured.select("stratum").distinct().agg((F.count("*") * sum(map(len, GRID.values()))).alias("tests"))
    a = limit / len(GRID)
    # a share of rejections above the limit can't pass; its tail needs no sum
    hopeful = tests.where(F.col("k") < F.col("n") * a).crossJoin(count)  # one row
    passed = hopeful.where(binomial_tail(F.col("k"), F.col("n"), a) <= F.log(F.lit(delta) / F.col("tests")))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRID])


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the stratum's cutoffs."""
    measured = stage(features(docs), "quality")
    # one row for each stratum; written, so that its size is known before the join is planned
    cuts = stage(thresholds(measured, labels, limit, delta), "cutoffs")
    fine = [F.coalesce(_ratio(r) <= F.col(f"cut_{r}"), F.lit(True)) for r in GRID]
    kept = ~base_failed()
    for f in fine:
        kept = kept & f
    return measured.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"),
        *[f"cut_{r}" for r in GRID])

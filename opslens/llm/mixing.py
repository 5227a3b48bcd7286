"""Operator 8, mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source; a leaf's supply is the tokens of its
documents times the epochs it may be read. A node's budget goes to its children
by weight; a child that cannot use its share leaves the rest to its siblings
(water-filling), and only what all siblings together cannot use is left to the
node's own siblings, as a node's capacity is the sum of its leaves' supplies.

A leaf with budget b and t tokens takes whole epochs of its documents and, of
the next epoch, the prefix of documents in that epoch's seeded order whose
tokens, summed before each document, stay below the rest.

The prefix is found in two steps so that a leaf with a third of all rows never
sits in one task: token sums of ``BUCKETS`` ranges of the order's hash, then the
order within the one range in which the budget ends.

All of it is DataFrame functions. Defined results: null lang or source is a leaf
of its own (named ''); documents without words have no tokens, cost nothing and
are taken with the place their hash gives them; rows that repeat count each;
an empty table gives no row; a weight that is missing is 1, a negative one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import stage

BUCKETS = 1 << 12
SEED = 11


def n_words(text: Column) -> Column:
    """Tokens as the mixture counts them: runs of characters that aren't blank."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def default_domain(source: Column) -> Column:
    """Four domains, by the number in the source's name."""
    return F.concat(F.lit("domain"), F.coalesce(F.pmod(F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(4)), F.lit(0)).cast("string"))


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each parent to its children by ``weight``, none over its
    ``capacity``: adds ``share``. One row per node of the tree."""
    w = Window.partitionBy(*parent).orderBy("_ratio", "_name")
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    wide = nodes.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))) \
        .withColumn("_full", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("_open", F.sum("weight").over(rest))
    # children in order of capacity per weight fill up until the level holds the rest
    wide = wide.withColumn("_sat", (F.col("weight") > 0) & (F.col("_full") + F.col("_ratio") * F.col("_open") <= F.col("budget")))
    sums = wide.groupBy(*parent).agg(
        F.sum(F.when(F.col("_sat"), F.col("capacity")).otherwise(0.0)).alias("_used"),
        F.sum(F.when(F.col("_sat"), 0.0).otherwise(F.col("weight"))).alias("_left"))
    return wide.join(sums, parent).withColumn("share", F.when(F.col("_sat"), F.col("capacity")).when(
        F.col("_left") > 0, F.col("weight") * (F.col("budget") - F.col("_used")) / F.col("_left")).otherwise(0.0)) \
        .drop("_ratio", "_full", "_open", "_sat", "_used", "_left")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: float | None, fraction: float, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens) -> with ``budget``: tokens to take."""
    def weight(level: str) -> Column:
        table = weights.get(level) or {}
        given = F.coalesce(*[F.when(F.col(level) == k, F.lit(float(v))) for k, v in table.items()], F.lit(1.0))
        return F.greatest(given, F.lit(0.0))

    leaves = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    usable = leaves.where((weight("domain") > 0) & (weight("lang") > 0) & (weight("source") > 0))
    top = usable.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight("domain")).withColumn("_name", F.col("domain"))
    want = leaves.agg((F.lit(float(total)) if total is not None else F.sum("tokens") * fraction).alias("_want"))
    # one row for each domain; the least of what is wanted and what there is
    have = usable.agg(F.sum("capacity").alias("_have"))
    top = top.crossJoin(want).crossJoin(have).withColumn("budget", F.least("_want", "_have")).withColumn("_root", F.lit(0))
    domains = _fill(top, ["_root"]).select("domain", F.col("share").alias("budget"))
    langs = usable.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight("lang")).withColumn("_name", F.col("lang"))
    langs = _fill(langs.join(domains, "domain"), ["domain"]).select("domain", "lang", F.col("share").alias("budget"))
    low = usable.withColumn("weight", weight("source")).withColumn("_name", F.col("source"))
    return _fill(low.join(langs, ["domain", "lang"]), ["domain", "lang"]).select("domain", "lang", "source", "tokens", F.col("share").alias("budget"))


def mixture(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, total: float | None = None,
            fraction: float = 0.8, epochs: int = 2, seed: int = SEED, domain=default_domain) -> DataFrame:
    """The chosen (document, epoch) rows: doc_id, text_hash, domain, lang,
    source, n_tokens, epoch (from 0), place (tokens before it in its epoch's
    order, only of those in the range where the budget ends; else null), n_same.

    ``total`` is the budget in tokens; without it, ``fraction`` of all tokens.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), domain(F.col("source")).alias("domain"),
                       F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       n_words(F.col("text")).alias("n_tokens"))
    # rows that repeat are one row with a count
    rows = stage(rows.groupBy("doc_id", "text_hash", "domain", "lang", "source", "n_tokens").agg(F.count("*").alias("n_same")), "mix-rows")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum(F.col("n_tokens") * F.col("n_same")).alias("tokens"))
    plan = stage(leaf_budgets(leaves, weights or {}, total, fraction, epochs), "mix-plan") \
        .withColumn("whole", F.when(F.col("tokens") > 0, F.floor((F.col("budget") + 1e-6) / F.col("tokens"))).otherwise(epochs).cast("int")) \
        .withColumn("rest", F.when(F.col("tokens") > 0, F.floor(F.col("budget") + 1e-6) - F.col("whole") * F.col("tokens")).otherwise(0).cast("long"))
    size = F.col("n_tokens") * F.col("n_same")
    # the plan has one row for each leaf of the tree
    mine = rows.join(plan.select(*leaf, "whole", "rest"), leaf)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string"), F.col("text_hash").cast("string")))
    mine = mine.withColumn("order", order).withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    sums = mine.groupBy(*leaf, "bucket").agg(F.sum(size).alias("sum"), F.first("rest").alias("rest"))
    w = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(w), F.lit(0)))
    part = mine.drop("rest").join(sums, [*leaf, "bucket"])
    inside = Window.partitionBy(*leaf, "bucket").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("sum") > F.col("rest"))
    full = part.where(F.col("ahead") + F.col("sum") <= F.col("rest")).where("rest > 0").withColumn("place", F.lit(None).cast("long"))
    cut = part.where(edge).withColumn("place", F.col("ahead") + F.coalesce(F.sum(size).over(inside), F.lit(0))).where("place < rest")
    out = ["doc_id", "text_hash", *leaf, "n_tokens", "epoch", "place", "n_same"]
    last = full.unionByName(cut).withColumn("epoch", F.col("whole")).select(*out)
    whole = mine.where("whole > 0").withColumn("place", F.lit(None).cast("long")) \
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*out)
    return whole.unionByName(last)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The chosen documents with their columns, once for each epoch."""
    chosen = mixture(docs, **options).groupBy("doc_id", "text_hash", "lang", "source").agg(F.count("*").cast("int").alias("_times")) \
        .toDF("_d", "_h", "_l", "_s", "_times")
    chosen = stage(chosen, "mixed")
    same = docs["doc_id"].eqNullSafe(chosen["_d"]) & (F.xxhash64(docs["text"]) == chosen["_h"]) \
        & (F.coalesce(docs["lang"], F.lit("")) == chosen["_l"]) & (F.coalesce(docs["source"], F.lit("")) == chosen["_s"])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.join(chosen, same).select(row, F.explode(F.sequence(F.lit(1), chosen["_times"])).alias("epoch")).select("row.*")

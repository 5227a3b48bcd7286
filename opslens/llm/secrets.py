"""Operator 7, secret scan with corpus-wide ownership. DataFrame functions only.

Candidates are found by regular expressions, leftmost and non-overlapping for
each kind, and placed in code points. Their values' hashes are counted over the
whole corpus by distinct repositories and owners: a value that many owners hold
is a copied example, one that a single owner holds looks live. The base kinds
(assign, access, hex) are always reported; tokens with a provider's prefix are
added where their value is not a copied example.

A repository is a source in one language and an owner is a source unless the
caller says otherwise. Counting distinct owners goes over distinct (hash, owner)
pairs, so a value in a third of all rows is reduced before the shuffle; the
counts are joined back over ``SALTS`` copies of each count, so its rows spread.

Defined results: null text is empty; null source is an owner of its own;
repeated rows each get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from opslens.llm.common import stage

#: Pattern, group that holds the value, least length of that group; in the order of the kinds
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
    "token": (r"((?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}))", 1, 12),
}
BASE = ("assign", "access", "hex")
SALTS = 8
EXAMPLE_OWNERS = 4  # a value that so many owners hold is a copied example


def _pieces(text: Column, number: int, kind: str) -> Column:
    """Array of (kind, idx, gap, size, fits, hash): each match, with the code
    points between the last one and it."""
    pattern, group, least = KINDS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    zipped = F.arrays_zip(F.transform(whole, lambda x: F.length(x)).alias("size"), value.alias("value"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"))
    found = F.transform(zipped, lambda z, i: F.struct(
        F.lit(number).alias("kind"), i.alias("idx"), z["gap"].alias("gap"), z["size"].alias("size"),
        (F.length(z["value"]) >= least).alias("fits"), F.xxhash64(z["value"]).alias("hash")))
    empty = F.array().cast("array<struct<kind:int,idx:int,gap:int,size:int,fits:boolean,hash:bigint>>")
    return F.when(text.rlike(pattern), found).otherwise(empty)


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """doc_id, text_hash, owner, repository, pieces for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source, lang = F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))
    owner = source if owner is None else owner
    repository = F.concat_ws("/", source, lang) if repository is None else repository
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), owner.alias("owner"), repository.alias("repository"),
                       F.concat(*[_pieces(text, n, k) for n, k in enumerate(KINDS)]).alias("pieces"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of every fitting candidate value."""
    # folded by value, owner and repository first: a repository may have several owners
    rows = found.select("owner", "repository", F.explode("pieces").alias("p")).where("p.fits") \
        .select(F.col("p.hash").alias("hash"), "owner", "repository").distinct()
    return rows.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repository").alias("n_repositories"))


def secrets(docs: DataFrame, **by) -> DataFrame:
    """doc_id, text_hash, spans (array of kind, start, end, verdict by start,
    then kind) and the counts of the base kinds, for every row of ``docs``."""
    found = stage(scan(docs, **by), "secrets")
    owned = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.where(F.size("pieces") > 0).select("doc_id", "text_hash", F.inline("pieces")).distinct()
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("idx")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).where("fits")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    rows = rows.join(owned, ["hash", "salt"]).withColumn(
        "verdict", F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("n_owners") == 1, "live").otherwise("shared"))
    base = F.col("kind") < len(BASE)
    rows = rows.where(base | (F.col("verdict") != "example"))
    spans = rows.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("spans"),
        *[F.sum((F.col("kind") == n).cast("long")).alias(f"n_{k}") for n, k in enumerate(BASE)])
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = spans.withColumn("spans", F.transform("spans", lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["verdict"].alias("verdict")))) \
        .withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    every = found.select("doc_id", "text_hash")
    return every.join(spans, every["doc_id"].eqNullSafe(spans["_d"]) & (every["text_hash"] == spans["_h"]), "left").drop("_d", "_h")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``secrets``' rows."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(spans: Column, verdict: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["verdict"] == verdict)).cast("long")

    spans = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(spans).alias("spans"), *[number(spans, v).alias(f"n_{v}") for v in ("live", "shared", "example")])

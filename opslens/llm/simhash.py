"""Operator 5, SimHash near-dedup: a self-join of binary tries.

A document's fingerprint is the majority of its shingles' hashes, bit by bit.
Equal fingerprints are one class. Distinct fingerprints that differ in at most
``MAX_BITS`` bits are linked by walking binary tries in pairs of nodes, adding
up the differing bits and leaving a pair once the budget is spent.

The walk is dealt out so that no group is unbounded: two fingerprints within
two bits of each other differ in at most two of the eight bytes. For each
choice of two bytes the trie is laid out with the other six bytes on top; a
pair of nodes below the top can only meet in the subtree of equal six bytes, and
a subtree over the last two bytes has at most 65 536 leaves, however many
documents or copies there are. Each fingerprint is in 28 tries, each subtree of
two or more leaves is walked as a whole in one task, and links leave the task as
a spanning forest, so a dense cluster never becomes all its pairs.

Defined results: null or empty texts have fingerprint zero and are linked like
others; a null doc_id takes part and gets its component's smallest id; repeated
rows are rows of one class.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import stage
from opslens.llm.components import connected_components

MAX_BITS = 2
SHINGLE = 3
SEED = 42
FREE = list(combinations(range(8), 2))  # the two bytes at the bottom of each trie

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------ fingerprints

def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; element i counts bit i."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text as a signed number."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, total, block = np.zeros(64, np.int64), 0, 1 << 16
    for lo in range(0, max(1, len(words) - size + 1), block):
        part = words[lo:lo + block + size - 1]
        if len(part) <= size:
            shingles = [" ".join(part)]
        else:
            shingles = list(map(" ".join, zip(*(part[k:len(part) - size + 1 + k] for k in range(size)))))
        h = np.array([digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles], np.uint64)
        ones += _ones(h)
        total += len(h)
    bits = np.packbits(2 * ones > total, bitorder="little").view(np.int64)
    return int(bits[0])


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """Fingerprint column (long) of a text column."""
    @F.arrow_udf("long")
    def simhash(t: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_py(), size) for x in t], pa.int64())
    return simhash(text)


# -------------------------------------------------------- walk of the tries

def walk(keys: np.ndarray, group: np.ndarray, width: int = 16, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j in one group whose ``width``-bit keys differ in
    1..``budget`` bits. ``keys`` must be sorted and distinct within each group,
    ``group`` ascending.

    One trie per group, all walked together, a level at a time. A node is the
    range of its leaves; a range splits where the level's bit turns to one.
    """
    n = len(keys)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    many = last - first > 1
    a0, a1 = first[many], last[many]
    b0, b1, diff = a0, a1, np.zeros(len(a0), np.int8)
    for level in range(width - 1, -1, -1):
        ones = np.r_[0, np.cumsum(keys >> level & 1)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        children = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1),
                    (am[~same], a1[~same], b0[~same], bm[~same], diff[~same] + 1)]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*children))
        live = (a0 < a1) & (b0 < b1) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, diff = a0[live], a1[live], b0[live], b1[live], diff[live]
    return np.minimum(a0, b0), np.maximum(a0, b0)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over links (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = np.minimum(low, low[low])
        if (low == before).all():
            return low


def _forest_edges(batches):
    """(free, fps) rows, one per subtree -> edges (a, b) of a spanning forest."""
    for batch in batches:
        size = np.array([len(x) for x in batch.column("fps")], np.int64)
        group = np.repeat(np.arange(len(size)), size)
        fps = batch.column("fps").flatten().to_numpy(zero_copy_only=False)
        pick = np.array(FREE)[batch.column("free").to_numpy(zero_copy_only=False)][group]
        raw = fps.view(np.uint64)
        byte = lambda k: raw >> (8 * pick[:, k]).astype(np.uint64) & np.uint64(255)
        keys = (byte(1) << np.uint64(8) | byte(0)).astype(np.int64)
        order = np.lexsort((keys, group))
        keys, fps, group = keys[order], fps[order], group[order]
        i, j = walk(keys, group)
        low = forest(len(fps), i, j)
        moved = np.flatnonzero(low != np.arange(len(fps)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[low[moved]])], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect all of those
    within ``MAX_BITS`` bits, directly or over others."""
    holes = [(255 << 8 * p) | (255 << 8 * q) for p, q in FREE]
    masks = [~(h - (1 << 64) if h >> 63 else h) for h in holes]  # as signed longs
    tops = F.array(*[F.struct(F.lit(k).alias("free"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("top"))
                     for k, m in enumerate(masks)])
    subtrees = fps.select("fp", F.inline(tops)).groupBy("free", "top") \
        .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("free", "fps")
    return subtrees.mapInArrow(_forest_edges, "a long, b long").distinct()


# ---------------------------------------------------------------- operator

def simhash_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long), root (long, a fingerprint of the class), component_id
    for every row of ``docs``."""
    return _components(docs, size).drop("text_hash")


def _components(docs: DataFrame, size: int) -> DataFrame:
    marked = stage(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp"), F.xxhash64("text").alias("text_hash")), "simhash")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp")))
    named = classes.join(roots, classes["fp"] == roots["node"], "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"), "least")
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stage(named.join(low, "root").select("fp", "root", "component_id"), "members")
    return marked.join(table, "fp").select("doc_id", "fp", "root", "component_id", "text_hash")


def simhash_dedup(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group: the row of the smallest doc_id, then
    fingerprint and text hash (one of them where rows repeat; a null doc_id only
    in a group without another); columns as in ``docs``."""
    # a fingerprint is its text's, so doc_id and text hash name the row
    keepers = stage(_components(docs, size).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash")).alias("k"))
        .select(F.col("k.doc_id").alias("_keep"), F.col("k.text_hash").alias("_hash")), "keepers")
    kept = docs.join(keepers, docs["doc_id"].eqNullSafe(keepers["_keep"]) & (F.xxhash64(docs["text"]) == keepers["_hash"]), "left_semi")
    again = kept.groupBy("doc_id", F.xxhash64("text")).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept

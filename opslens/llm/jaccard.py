"""Operator 13, n-gram Jaccard join: pivots, Voronoi regions and windows.

A document's set holds the 64-bit hashes of its distinct shingles; documents of
one set are one class. 1 - Jaccard is a metric, so a class in the Voronoi region
of pivot p can only link with a class of pivot q's region if the distance to q is
at most that to p plus twice the link distance: within that window it is
replicated to q's region, and regions join on their own. A region that holds
more than ``CELL`` shingles takes pivots of its own, and so on; a region whose
classes all link with one pivot is done.

Windows can't part sets that share nothing with any pivot: their distance to all
pivots is 1. So the space is cut first where no link crosses. Linked sets of
sizes a <= b differ in at most t = a (100 - percent) / percent shingles. The
shingles are dealt out by hash to t + 1 parts (t + 2 for small t), and linked sets
agree on one part at least (two parts). Sets that agree on a part (two parts) are
tied, ties form clusters, and a cluster is the first region. Agreement on a part
of one shingle or none says little; there a second deal must agree on a part too.

A region that windows don't divide (all of it within twice the link distance, but
not of one pivot) is cut in blocks, and each pair of blocks is a region.

Links leave a task as a spanning forest; large-star/small-star steps give the
components. No task holds more than a region, a pair of blocks, or one text.

Defined results: a null or empty text, or one without words, has an empty set, and
its component is its own doc_id; a null doc_id takes part and gets the smallest
id of its component (null if that has none); repeated rows are rows of one
class; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from opslens.llm.common import stage
from opslens.llm.components import connected_components
from opslens.llm.simhash import forest
from opslens.llm.words import Words, byte_classes, mix, runs, text_bytes

SHINGLE = 3
PERCENT = 90
CELL = 1_000_000   # shingles of a region that one task joins
PIVOTS = 32        # pivots of a region, at most
RUN = 3_000_000    # bytes of text looked at together, or one text

_KINDS = byte_classes(" \t\n\x0b\x0c\r")
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# ---------------------------------------------------------------------- sets

def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """(text number, sorted distinct hashes) of each text with a word."""
    raw, at = text_bytes(texts)
    for lo, hi in runs(at, RUN):
        w = Words(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], _KINDS)
        cut = np.searchsorted(w.doc, np.arange(hi - lo + 1))
        for i in np.flatnonzero(cut[1:] > cut[:-1]):
            h = w.hash[cut[i]:cut[i + 1]]
            steps = min(size, len(h))
            x = h[:len(h) - steps + 1] ^ np.uint64(steps)
            with np.errstate(over="ignore"):
                for k in range(1, steps):
                    x = mix(x * _A + h[k:len(h) - steps + 1 + k])
            yield lo + int(i), np.unique(x if steps > 1 else mix(x))


def similar(common, a, b, percent: int):
    """Whether sets of sizes a and b with so many common elements link."""
    return 100 * common >= percent * (a + b - common)


# ----------------------------------------------------------------- clusters

def size_classes(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, t) of classes; sets that link are of one
    class or of neighbours."""
    out, low = [], 1
    while low <= most:
        t = len(out)
        if t <= 3:  # one class for each of t = 0 to 3
            high = ((t + 1) * percent - 1) // (100 - percent)
        else:
            high = max(low, -(-low * max(125, -(-10000 // percent)) // 100) - 1)
        out.append((low, high, high * (100 - percent) // percent))
        low = high + 1
    return out


def _deal(h: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit sum of the hashes of each part, how many)."""
    x = mix(h ^ np.uint64(salt))
    part = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    y = mix(x ^ _B)
    low = np.bincount(part, (y & np.uint64(0xFFFFFFFF)).astype(float), parts)
    high = np.bincount(part, (y >> np.uint64(32)).astype(float), parts)
    # sums of under 2**21 numbers of 32 bits are exact in doubles; larger ones are still functions of the part
    total = (low.astype(np.uint64) & np.uint64(0xFFFFFFFF)) | (high.astype(np.uint64) << np.uint64(32))
    return total, np.bincount(part, minlength=parts)


def signatures(h: np.ndarray, classes: list[tuple[int, int, int]], percent: int) -> np.ndarray:
    """Numbers of which linked, different sets share at least one."""
    n = len(h)
    own = next(i for i, (low, high, _) in enumerate(classes) if n <= high)
    out = []
    for c in (own, own - 1):
        if c < 0 or not classes[c][2] or (c < own and n * percent > classes[c][1] * 100):
            continue
        t = classes[c][2]
        agree = 2 if t <= 3 else 1
        parts = t + agree
        total, count = _deal(h, parts, 2 * c + 1)
        with np.errstate(over="ignore"):
            if agree == 1:
                name, weak = mix(total + _A * np.arange(parts, dtype=np.uint64)), count <= 1
            else:
                i, j = np.array(list(combinations(range(parts), 2))).T
                name = mix(mix(total[i] + _A * i.astype(np.uint64)) + total[j] + _A * j.astype(np.uint64))
                weak = count[i] + count[j] <= 1
            out.append(name[~weak] + np.uint64(c))
            if weak.any():
                second, _ = _deal(h, t + 1, 2 * c + 2)
                again = mix(second + _B * np.arange(t + 1, dtype=np.uint64))
                out.append((mix(name[weak] + np.uint64(c))[:, None] ^ again[None, :]).ravel())
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _marks(size: int, percent: int):
    """(doc_id, th, text) -> doc_id, th, n, set key k1 k2, signatures."""
    def marks(batches):
        classes = size_classes(percent)
        for batch in batches:
            rows = batch.num_rows
            n, k1, k2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            found: dict[int, np.ndarray] = {}
            for i, h in shingle_sets(batch.column("text"), size):
                n[i] = len(h)
                k1[i], k2[i] = mix(h ^ _A).sum(dtype=np.uint64), mix(h ^ _B).sum(dtype=np.uint64)
                found[i] = signatures(h, classes, percent)
            lengths = np.array([len(found[i]) if i in found else 0 for i in range(rows)], np.int64)
            flat = np.concatenate([found[i] for i in range(rows) if i in found]) if found else np.zeros(0, np.uint64)
            sigs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), sigs],
                ["doc_id", "th", "n", "k1", "k2", "sigs"])
    return marks


def _clusters(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, clusters): classes (k1, k2, cid, doc_id, th, n), one row of the
    documents for each class that shares a signature; clusters (cid, cell)."""
    sigs = marked.select("k1", "k2", F.explode("sigs").alias("sig"))
    # copies are folded before the shuffle: a signature is kept if it has two different sets
    shared = sigs.groupBy("sig").agg(*[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]) \
        .where("min_k1 <> max_k1 OR min_k2 <> max_k2").select("sig")
    tied = stage(sigs.join(shared, "sig").distinct(), "tied")
    wanted = tied.select("k1", "k2").distinct()
    classes = stage(marked.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2")
                    .agg(F.min(F.struct("doc_id", "th", "n")).alias("m"))
                    .select("k1", "k2", "m.*", F.monotonically_increasing_id().alias("cid")), "set-classes")
    members = tied.join(classes, ["k1", "k2"]).select("sig", "cid")
    star = members.join(members.groupBy("sig").agg(F.min("cid").alias("centre")), "sig")
    roots = connected_components(star.select(F.col("centre").alias("a"), F.col("cid").alias("b")))
    return classes, roots.select(F.col("node").alias("cid"), F.col("root").alias("cell"))


# ------------------------------------------------------------------- regions

def _sets_of(size: int):
    """(cell, cid, text) -> cell, cid, n, h (the hashes as bytes)."""
    def sets(batches):
        for batch in batches:
            for i, h in shingle_sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cell").slice(i, 1), batch.column("cid").slice(i, 1), pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())],
                    ["cell", "cid", "n", "h"])
    return sets


def common_with(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """How many elements each of the sets shares with the pivot."""
    flat = np.concatenate(sets)
    place = np.searchsorted(pivot, flat)
    place[place == len(pivot)] = 0
    hit = (pivot[place] == flat).astype(np.int64)
    return np.add.reduceat(hit, np.cumsum([0] + [len(s) for s in sets[:-1]]))


def join_region(sets: list[np.ndarray], percent: int, pivots: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all linked sets of a region.

    Distances to a few far-apart pivots leave a window of candidates for each
    set; those that link with the same pivot need no further look."""
    g = len(sets)
    size = np.array([len(s) for s in sets])
    most = 1 - percent / 100 + 1e-9
    group = np.arange(g)
    found_i, found_j, table = [], [], []
    nearest, pivot = np.full(g, np.inf), int(np.argmax(size))
    for _ in range(min(pivots, g)):
        common = common_with(sets, sets[pivot])
        linked = np.flatnonzero(similar(common, size, size[pivot], percent))
        linked = linked[linked != pivot]
        found_i.append(np.full(len(linked), pivot))
        found_j.append(linked)
        d = 1 - common / (size + size[pivot] - common)
        table.append(d)
        nearest = np.minimum(nearest, d)
        nearest[pivot] = -1
        pivot = int(np.argmax(nearest))
        if nearest[pivot] <= 0:
            break
    group = forest(g, np.concatenate(found_i), np.concatenate(found_j))
    if len(np.unique(group)) > 1 and g > len(table):
        far = np.stack(table, 1)
        # who holds each element; an element of one set alone can't be shared
        flat, owner = np.concatenate(sets), np.repeat(np.arange(g), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        start = np.flatnonzero(new)
        count = np.diff(np.r_[start, len(flat)])
        element = np.cumsum(new) - 1
        keep = count[element] > 1
        by_set = np.argsort(owner[keep], kind="stable")
        elements = element[keep][by_set]
        bounds = np.searchsorted(owner[keep][by_set], np.arange(g + 1))
        for x in range(g):
            window = (np.abs(far - far[x]) <= most).all(1) & (group != group[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            window[:x + 1] = False
            if not window.any():
                continue
            mine = elements[bounds[x]:bounds[x + 1]]
            lengths = count[mine]
            if not len(mine):
                continue
            places = np.repeat(start[mine] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            common = np.bincount(owner[places], minlength=g)
            linked = np.flatnonzero(window & similar(common, size, size[x], percent))
            found_i.append(np.full(len(linked), x))
            found_j.append(linked)
    return np.concatenate(found_i), np.concatenate(found_j)


def _join_regions(percent: int):
    """Rows sorted by cell (cell, cid, h) -> edges (a, b), a forest each."""
    def edges(cids, sets):
        ids, at = np.unique(np.array(cids, np.int64), return_index=True)  # a class may come twice
        if len(ids) < 2:
            return
        i, j = join_region([sets[k] for k in at], percent)
        low = forest(len(ids), i, j)
        moved = np.flatnonzero(low != np.arange(len(ids)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[low[moved]])], ["a", "b"])

    def join(batches):
        now, cids, sets = None, [], []
        for batch in batches:
            for cell, cid, h in zip(batch.column("cell").to_pylist(), batch.column("cid").to_pylist(), batch.column("h")):
                if cell != now:
                    yield from edges(cids, sets)
                    now, cids, sets = cell, [], []
                cids.append(cid)
                sets.append(np.frombuffer(h.as_py(), np.uint64))
        yield from edges(cids, sets)
    return join


def _measure(percent: int):
    """Rows sorted by cell, salt, kind (0 pivots, then 1 members) -> members with
    the pivots they link with and the regions of their window."""
    reach = 2 * (1 - percent / 100) + 1e-9

    def measure(batches):
        now, pivots, names = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "kind", "cid", "n", "h"))):
                if (r[0], r[1]) != now:
                    now, pivots, names = (r[0], r[1]), [], []
                h = np.frombuffer(r[5], np.uint64)
                if r[2] == 0:
                    pivots.append(h)
                    names.append(r[3])
                    continue
                common = common_with(pivots, h)
                size = np.array([len(p) for p in pivots])
                d = 1 - common / (size + len(h) - common)
                linked = [names[k] for k in np.flatnonzero(similar(common, size, len(h), percent))]
                regions = [names[k] for k in np.flatnonzero(d <= d.min() + reach)]
                out.append((r[0], r[3], r[4], r[5], linked, regions))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                    ["cell", "cid", "n", "h", "linked", "regions"])
    return measure


def _divide(rows: DataFrame, sizes: DataFrame, percent: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Large regions -> (links with pivots, rows of the regions they fall into)."""
    order = F.xxhash64("cid", F.lit(11))
    held = rows.join(sizes.select("cell", "c", "w"), "cell")
    wanted = F.least(F.lit(PIVOTS), F.ceil(4 * F.col("w") / cell) + 1)
    # few rows a region by a threshold on the hash, then the first of them
    share = (order.cast("double") + 2.0 ** 63) / 2.0 ** 64
    few = held.where((share < 4 * wanted / F.col("c")) | (F.col("cid") == F.col("cell")))
    first = few.groupBy("cell", "c", "w").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "cid"))).alias("all")) \
        .select("cell", "c", F.explode(F.slice("all", F.lit(1), wanted.cast("int"))).alias("p")).select("cell", "c", F.col("p.cid").alias("cid"))
    salts = F.ceil(F.col("c") / 512)
    pivots = rows.join(stage(first, "pivots"), ["cell", "cid"]).select(
        "cell", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)).alias("salt"), F.lit(0).alias("kind"), "cid", "n", "h")
    members = held.select("cell", F.pmod(F.xxhash64("cid", F.lit(5)), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "cid", "n", "h")
    measured = stage(pivots.unionByName(members).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "cid")
                     .mapInArrow(_measure(percent), "cell long, cid long, n long, h binary, linked array<long>, regions array<long>"), "measured")
    linked = measured.select("cell", "cid", F.explode("linked").alias("p"))
    whole = linked.groupBy("cell", "p").agg(F.count("*").alias("k")).join(sizes.select("cell", "c"), "cell").where("k = c").select("cell").distinct()
    rest = measured.join(whole, "cell", "left_anti")
    fresh = rest.select(F.col("cell").alias("old"), F.explode("regions").alias("region"), "cid", "n", "h") \
        .withColumn("cell", F.xxhash64("old", "region"))
    weights = fresh.groupBy("old", "cell").agg(F.sum("n").alias("w")).groupBy("old").agg(F.sum("w").alias("total"), F.max("w").alias("most"))
    stuck = weights.join(sizes.select(F.col("cell").alias("old"), "w"), "old").where("total > 3 * w OR 10 * most > 9 * w").select("old", "w")
    stuck = stage(stuck, "stuck")
    parted = fresh.join(stuck.select("old"), "old", "left_anti").select("cell", "cid", "n", "h", F.lit(False).alias("block"))
    # blocks of half a region; each pair of blocks is a region
    blocks = F.ceil(2 * F.col("w") / cell).cast("int")
    mine = F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")).cast("int")
    paired = rest.join(stuck, rest["cell"] == stuck["old"]).withColumn("blocks", blocks).withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(F.xxhash64("old", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "cid", "n", "h", F.lit(True).alias("block"))
    return linked.select(F.col("cid").alias("a"), F.col("p").alias("b")), parted.unionByName(paired)


def _links(rows: DataFrame, percent: int, cell: int) -> DataFrame:
    """Regions (cell, cid, n, h) -> edges (a, b) that connect all linked sets."""
    rows = rows.withColumn("block", F.lit(False))
    out = None
    while True:
        rows = stage(rows, "regions")
        sizes = stage(rows.groupBy("cell").agg(F.sum("n").alias("w"), F.count("*").alias("c"), F.max("block").alias("block")), "region-sizes")
        large = sizes.where((F.col("w") > cell) & ~F.col("block") & (F.col("c") > 2))
        small = rows.join(large, "cell", "left_anti")
        edges = small.select("cell", "cid", "h").repartition("cell").sortWithinPartitions("cell").mapInArrow(_join_regions(percent), "a long, b long")
        out = edges if out is None else out.unionAll(edges)
        if large.isEmpty():
            return out
        near, rows = _divide(rows.join(large.select("cell"), "cell", "left_semi").drop("block"), large, percent, cell)
        out = stage(out.unionAll(near), "links")


# ------------------------------------------------------------------ operator

def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: documents
    whose sets have a Jaccard similarity of ``percent`` or more are linked."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), *[StructField(c, LongType()) for c in ("th", "n", "k1", "k2")], StructField("sigs", ArrayType(LongType()))])
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    marked = stage(texts.mapInArrow(_marks(size, percent), schema), "sets")
    some = marked.where("n > 0")
    classes, clusters = _clusters(some)
    reps = classes.join(clusters, "cid").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "cid", "cell")
    rows = texts.join(reps, texts["doc_id"].eqNullSafe(reps["_id"]) & (texts["th"] == reps["_th"])) \
        .select("cell", "cid", "text").dropDuplicates(["cid"]).mapInArrow(_sets_of(size), "cell long, cid long, n long, h binary")
    roots = connected_components(_links(rows, percent, cell))
    least = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots, F.col("cid") == F.col("node")).select("k1", "k2", "root")
    table = stage(least.join(named, ["k1", "k2"]).select("k1", "k2", "root", "least"), "linked")
    low = table.groupBy("root").agg(F.min("least").alias("low"))
    by_class = least.join(table.join(low, "root").select("k1", "k2", "low"), ["k1", "k2"], "left") \
        .select("k1", "k2", F.coalesce("low", "least").alias("component_id"))
    return some.join(by_class, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(
        marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

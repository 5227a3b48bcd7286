"""Operator 12, phrase collocation mining: counts in HAT-tries, merged as runs.

A task counts phrases in a shallow trie over the first word id; below it hang
hash containers (the rest of the phrase -> count). A container that grows past
``BURST`` entries bursts into a node over the next word. When a task holds more
than ``BUDGET`` entries it spills whole subtrees, the largest first, as sorted
runs, packed by ranges of prefixes (hashes of the first two words; as many ranges
as the corpus asks for). Spark deals the runs out by range, and each range is
merged on its own.

The text is read four times. A phrase can reach ``min_count`` only if its parts
do, so the first reading counts words, the second counts pairs of frequent words
by a hash that grows with the corpus (16 values a word), the third counts the
longer phrases all of whose pairs may be frequent in the same way, and the last
counts in tries the phrases that may be frequent themselves. Hashes travel as
sorted runs of differences, dealt out by ranges of 2**20 hashes; a range is
merged in a plain array. What may be frequent goes to the tasks as bit tables of
a fixed size (``BITS``); where a hash or a table lets an infrequent phrase
through, the last merge drops it.

A word's id is a 64-bit hash of language and word, so a phrase carries its
language. Words are counted by their text; two frequent words of one id (chance
2**-64 a pair) would be told apart in the word table only.

Defined results: a null text has no words; a null language is ``und``; repeated
rows count as often as they stand there; an empty table gives no rows; only the
columns text and lang are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import stage
from opslens.llm.words import Words, byte_classes, mix, runs, text_bytes

LONGEST = 5
BURST = 16_384      # entries of a hash container before it bursts
BUDGET = 400_000    # entries a task holds before it spills subtrees
BITS = 1 << 25      # of the table of frequent words, pairs or longer phrases: 4 MB
RANGE = 20          # low bits of a phrase's hash that one range holds
HASHES = 3_000_000  # hashes of phrases a task holds before it spills them as a run
RUN = 3_000_000     # bytes of text looked at together, or one text
SALTS = 64          # parts of a language that rank their phrases first

_KINDS = byte_classes(" \t", ".,;:!?\n\x0b\x0c\r")


# ------------------------------------------------------------------ the trie

class HatTrie:
    """Counts of phrases (tuples of word ids)."""

    def __init__(self, burst: int = BURST, budget: int = BUDGET):
        self.root: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}   # entries below each first word
        self.burst, self.budget, self.held = burst, budget, 0
        self.burst_children: set[int] = set()

    def add(self, phrase: tuple, count: int) -> None:
        first, rest = phrase[0], phrase[1:]
        child = self.root.get(first)
        if child is None:
            child = self.root[first] = {}
            self.sizes[first] = 0
        if first in self.burst_children:
            box = child.get(rest[0])
            if box is None:
                box = child[rest[0]] = {}
            key = rest[1:]
        else:
            box, key = child, rest
        before = box.get(key)
        if before is not None:
            box[key] = before + count
            return
        box[key] = count
        self.sizes[first] += 1
        self.held += 1
        if box is child and len(child) > self.burst:
            self._burst(first)

    def _burst(self, first: int) -> None:
        node: dict[int, dict] = {}
        for rest, count in self.root[first].items():
            node.setdefault(rest[0], {})[rest[1:]] = count
        self.root[first] = node
        self.burst_children.add(first)

    def _subtree(self, first: int) -> list[tuple[tuple, int]]:
        child = self.root.pop(first)
        self.held -= self.sizes.pop(first)
        if first not in self.burst_children:
            return sorted(((first, *rest), n) for rest, n in child.items())
        self.burst_children.discard(first)
        return sorted(((first, second, *rest), n) for second, box in child.items() for rest, n in box.items())

    def spill(self, everything: bool = False) -> Iterator[list[tuple[tuple, int]]]:
        """Sorted runs: the largest subtrees until half of the budget is left,
        or all of them."""
        if not everything and self.held <= self.budget:
            return
        if everything:
            run: list[tuple[tuple, int]] = []
            for first in sorted(self.root):
                run += self._subtree(first)
                if len(run) > self.burst:
                    yield run
                    run = []
            if run:
                yield run
            return
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.held <= self.budget // 2:
                return
            yield self._subtree(first)


def _as_batch(run: list[tuple[tuple, int]], bits: int) -> pa.RecordBatch:
    """A sorted run as packed rows (range, n, run), one for each range of the
    first two words that it has phrases of; short phrases are padded with 0."""
    rows = np.array([(*p, *(0,) * (LONGEST - len(p)), n) for p, n in run], np.int64)
    top = (_pair_key(rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(top, kind="stable")
    rows, top = rows[order], top[order]
    cut = np.r_[np.flatnonzero(np.r_[True, top[1:] != top[:-1]]), len(top)]
    return pa.RecordBatch.from_arrays(
        [pa.array(top[cut[:-1]]), pa.array(np.diff(cut)), pa.array([rows[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["range", "n", "run"])


# ------------------------------------------------------- readings of the text

def _language_ids(langs: list[str | None]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b((x or "und").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
             for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _readings(batch: pa.RecordBatch):
    """(words, id of each word, language of each text) of each run of texts."""
    raw, at = text_bytes(batch.column("text"))
    langs = batch.column("lang").to_pylist()
    codes = _language_ids(langs)
    for lo, hi in runs(at, RUN):
        w = Words(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], _KINDS)
        if len(w):
            yield w, mix(w.hash ^ codes[lo:hi][w.doc]), langs[lo:hi]


def _word_counts(batches):
    """Rows (id, lang, word, f); word null: all words of the language."""
    held: dict[int, list] = {}
    total: dict[str, int] = {}

    def rows(box):
        return pa.RecordBatch.from_arrays([
            pa.array(list(box), pa.int64()), pa.array([v[0] for v in box.values()], pa.string()),
            pa.array([v[1] for v in box.values()], pa.string()), pa.array([v[2] for v in box.values()], pa.int64())],
            ["id", "lang", "word", "f"])

    for batch in batches:
        for w, ids, langs in _readings(batch):
            found, at, n = np.unique(ids, return_index=True, return_counts=True)
            for lang, k in zip(*np.unique(w.doc, return_counts=True)):
                name = langs[lang] if langs[lang] is not None else "und"
                total[name] = total.get(name, 0) + int(k)
            for key, i, k in zip(found.view(np.int64).tolist(), at.tolist(), n.tolist()):
                entry = held.get(key)
                if entry is None:
                    lang = langs[w.doc[i]]
                    held[key] = [lang if lang is not None else "und", w.text(i), k]
                else:
                    entry[2] += k
            if len(held) > BUDGET:
                yield rows(held)
                held = {}
    if held:
        yield rows(held)
    if total:
        yield pa.RecordBatch.from_arrays([
            pa.array([0] * len(total), pa.int64()), pa.array(list(total), pa.string()),
            pa.array([None] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["id", "lang", "word", "f"])


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set in the table of 64-bit words."""
    place = keys & np.uint64(BITS - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _hash_runs(hashes, bits: int, hold: int):
    """Rows (range, n, run): how often each value of the first ``bits`` bits of
    ``hashes(words, ids)`` occurs."""
    def fold(parts):
        keys, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    def spilled(keys, n):
        top = keys >> np.uint64(RANGE)
        cut = np.r_[np.flatnonzero(np.r_[True, top[1:] != top[:-1]]), len(keys)]
        low = (keys & np.uint64((1 << RANGE) - 1)).astype(np.uint32)
        out = []
        for a, b in zip(cut, cut[1:]):
            # differences and counts, byte by byte of all, which packs well
            both = np.stack([np.diff(low[a:b], prepend=np.uint32(0)), n[a:b].astype(np.uint32)])
            out.append(both.view(np.uint8).reshape(2, b - a, 4).transpose(0, 2, 1).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(top[cut[:-1]].astype(np.int64)), pa.array(np.diff(cut).astype(np.int64)), pa.array(out, pa.binary())],
                                          ["range", "n", "run"])

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for w, ids, _ in _readings(batch):
                found = hashes(w, ids)
                if not len(found):
                    continue
                parts.append(np.unique(found >> np.uint64(64 - bits), return_counts=True))
                held += len(parts[-1][0])
                if held > hold:
                    parts = [fold(parts)]
                    held = len(parts[0][0])
                    if 2 * held > hold:
                        yield spilled(*parts[0])
                        parts, held = [], 0
        if parts:
            yield spilled(*fold(parts))
    return count


def _merge_hashes(min_count: int):
    """Runs sorted by range -> hashes that occur often enough (key)."""
    def often(top, sums):
        at = np.flatnonzero(sums >= min_count)
        sums[:] = 0
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + (top << RANGE))], ["key"])

    def merge(batches):
        sums, now = np.zeros(1 << RANGE, np.int64), None
        for batch in batches:
            for top, n, run in zip(*(batch.column(c).to_pylist() for c in ("range", "n", "run"))):
                if now is not None and top != now:
                    yield often(now, sums)
                now = top
                low, f = np.frombuffer(run, np.uint8).reshape(2, 4, n).transpose(0, 2, 1).copy().view(np.uint32)[..., 0]
                sums[np.cumsum(low, dtype=np.int64)] += f
        if now is not None:
            yield often(now, sums)
    return merge


def _chains(w: Words, ids: np.ndarray, table: np.ndarray, bits: int):
    """(length, places, keys) of the phrases all of whose pairs pass the table."""
    same = np.flatnonzero(w.piece[:-1] == w.piece[1:])
    pairs = np.zeros(max(0, len(ids) - 1), bool)
    pairs[same] = _passes(table, _pair_key(ids[same], ids[same + 1]) >> np.uint64(64 - bits))
    chain, key = pairs, ids
    for size in range(2, LONGEST + 1):
        if size > 2:
            chain = chain[:-1] & pairs[size - 2:] if len(chain) > 1 else chain[:0]
        at = np.flatnonzero(chain)
        if not len(at):
            return
        with np.errstate(over="ignore"):
            key = _pair_key(ids[:-1], ids[1:]) if size == 2 else mix(key[:-1] * np.uint64(0xD6E8FEB86659FD93) + ids[size - 1:])
        yield size, at, key[at]


def _pair_hashes(words):
    def hashes(w: Words, ids: np.ndarray) -> np.ndarray:
        good = _passes(words.value, ids)
        at = np.flatnonzero(good[:-1] & good[1:] & (w.piece[:-1] == w.piece[1:]))
        return _pair_key(ids[at], ids[at + 1])
    return hashes


def _longer_hashes(pairs, bits: int):
    def hashes(w: Words, ids: np.ndarray) -> np.ndarray:
        found = [key for size, _, key in _chains(w, ids, pairs.value, bits) if size > 2]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes


def _phrases(w: Words, ids: np.ndarray, pairs: np.ndarray, longer: np.ndarray, bits: int):
    """(matrix of ids, counts) of the distinct phrases of a run that pass the
    tables, by length."""
    for size, at, key in _chains(w, ids, pairs, bits):
        if size > 2:
            good = _passes(longer, key >> np.uint64(64 - bits))
            at, key = at[good], key[good]
        if len(at):
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            first = at[first]
            yield np.stack([ids[first + k] for k in range(size)], axis=1).view(np.int64), n


def _phrase_counts(pairs, longer, bits: int, burst: int, budget: int):
    def count(batches):
        trie = HatTrie(burst, budget)
        for batch in batches:
            for w, ids, _ in _readings(batch):
                for matrix, n in _phrases(w, ids, pairs.value, longer.value, bits):
                    for phrase, k in zip(zip(*matrix.T.tolist()), n.tolist()):
                        trie.add(phrase, k)
                    for run in trie.spill():
                        yield _as_batch(run, max(4, bits - RANGE))
        for run in trie.spill(everything=True):
            yield _as_batch(run, max(4, bits - RANGE))
    return count


def _merge(min_count: int):
    """Runs sorted by range -> one row for each phrase counted often enough."""
    def often(runs):
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, LONGEST + 1) for x in runs])
        rows = rows[np.lexsort(rows[:, LONGEST - 1::-1].T)]
        at = np.flatnonzero(np.r_[True, (rows[1:, :LONGEST] != rows[:-1, :LONGEST]).any(1)])
        sums = np.add.reduceat(rows[:, LONGEST], at)
        return _merged(rows[at[sums >= min_count], :LONGEST], sums[sums >= min_count])

    def merge(batches):
        now, runs = None, []
        for batch in batches:
            for top, run in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist()):
                if now is not None and top != now:
                    yield often(runs)
                    runs = []
                now = top
                runs.append(run)
        if runs:
            yield often(runs)
    return merge


def _merged(phrases: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    words = [p[:np.count_nonzero(p)].tolist() for p in phrases]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["words", "f"])


def _bit_table(keys: DataFrame):
    """Broadcast bit table of the column ``key``; its size is ``BITS``."""
    spark = keys.sparkSession
    place = F.col("key").bitwiseAND(F.lit(BITS - 1))
    cells = keys.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")) \
        .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most BITS / 64 rows
    table = np.zeros(BITS // 64, np.uint64)
    table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table)


# ------------------------------------------------------------------ operator

def phrase_counts(docs: DataFrame, min_count: int, burst: int = BURST, budget: int = BUDGET, hold: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words (id, lang, word, f), with one row of null word a
    language for all its words; phrases (words, an array of 1 to 5 ids, and f),
    for all that occur ``min_count`` times or more."""
    texts = docs.select("text", "lang")
    schema = "range long, n long, run binary"
    found = texts.mapInArrow(_word_counts, "id long, lang string, word string, f long") \
        .groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))
    words = stage(found.where((F.col("f") >= min_count) | F.col("word").isNull()), "words")
    often = words.where("word IS NOT NULL")
    total = words.where("word IS NULL").agg(F.sum("f")).first()[0] or 0
    bits = max(RANGE, (16 * total).bit_length())  # a word begins four phrases at most

    def likely(hashes, name: str):
        found = texts.mapInArrow(_hash_runs(hashes, bits, hold), schema).repartition("range") \
            .sortWithinPartitions("range").mapInArrow(_merge_hashes(min_count), "key long")
        return _bit_table(stage(found, name))

    pairs = likely(_pair_hashes(_bit_table(often.select(F.col("id").alias("key")))), "pairs")
    longer = likely(_longer_hashes(pairs, bits), "longer")
    counted = texts.mapInArrow(_phrase_counts(pairs, longer, bits, burst, budget), schema)
    merged = counted.repartition("range").sortWithinPartitions("range").mapInArrow(_merge(min_count), "words array<long>, f long")
    return words, often.select(F.array("id").alias("words"), "f").unionAll(stage(merged, "phrases"))


def exact_score():
    """floor(1000 a n / (l r)) of long columns, in decimals of 38 digits."""
    return F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)))"
                  " div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, burst: int = BURST, budget: int = BUDGET,
                 hold: int = HASHES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    ``score`` is the lowest of floor(1000 a n / (l r)) over the phrase's cuts;
    a phrase is left out if one that holds it occurs as often.
    """
    words, counts = phrase_counts(docs, min_count, burst, budget, hold)
    size = F.size("words")
    cand = counts.where(size > 1).select("words", F.col("f").alias("a"))
    # a longer phrase of the same count implies one that is one word longer
    held = cand.where(size > 2).select("a", F.explode(F.array(
        F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("part")) \
        .groupBy("part").agg(F.max("a").alias("within"))
    free = cand.join(held, cand["words"] == held["part"], "left") \
        .where(F.col("within").isNull() | (F.col("within") < F.col("a"))).select("words", "a")
    word = words.where("word IS NOT NULL").select("id", "lang", "word")
    total = words.where("word IS NULL").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    # texts of the phrases, and their language
    text = free.select("words", "a", F.posexplode("words").alias("at", "id")).join(word, "id") \
        .groupBy("words", "a").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("t"), F.min("lang").alias("lang")) \
        .select("words", "a", "lang", F.array_join(F.transform("t", lambda x: x["word"]), " ").alias("phrase"))
    cuts = text.join(total, F.col("lang") == F.col("_lang")).select(
        "words", "a", "lang", "phrase", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")) \
        .withColumn("left", F.slice("words", F.lit(1), F.col("k"))) \
        .withColumn("right", F.slice("words", F.col("k") + 1, size))
    left = counts.select(F.col("words").alias("left"), F.col("f").alias("l"))
    right = counts.select(F.col("words").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, "left").join(right, "right").withColumn("score", exact_score())
    best = scored.groupBy("lang", "words", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")) \
        .select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = best.withColumn("_s", part).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))) \
        .where(F.col("_k") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Operator 9, benchmark decontamination by templates.

Words are canonicalised: numbers, units and names become typed placeholders.
Three streams are made of each text, one that keeps names as words (a re-numbered
question), one in which every capitalised word is a name (a question retold with
other names) and one that keeps all words (a verbatim copy). Windows of eight
canonical words are hashed; document windows that a bounded filter of the
benchmark's hashes lets through are hash-joined to the benchmark's windows. A
window counts if its slots fit: each placeholder value of the item stands for one
value in the document's window, and the other way round. A window that doesn't
fit is left out alone; the others of its diagonal count.

A document holds an item if ``min(RUN, windows of the item)`` different windows
of one stream lie on one diagonal; RUN windows of eight are a run of 13 words.
Windows with placeholders need a word in half of their places; those of the
verbatim stream have no placeholder, so an item of numbers is found by them.
Items of 3 to 7 words have one window, the whole item; shorter ones are never
matched. The result is whole: no window or document is capped.

Defined results: null or empty texts match nothing; rows with a null doc_id are
judged by their text, as rows with equal doc_id and text are the same document.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import slices, stage

WINDOW = 8
RUN = 6
SHORTEST = 3
STREAMS = 3  # names kept, names replaced, all words kept
FILTER_BITS = 22  # the filter has 2^22 places, however large the benchmark is

#: Words for units of measure.
UNITS = frozenset("""mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds
ounce ounces lb lbs oz ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr hrs day days week weeks
month months year years cent cents dollar dollars euro euros pence usd eur gbp percent degree degrees celsius fahrenheit watt watts volt volts
meter meters metre metres mph kph""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th|[a-z]{1,2})?")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡"
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_SLOT = {"num": 0x1234567, "unit": 0x2345678, "name": 0x3456789}


def canonical(word: str) -> tuple[int, int, int, bool, bool, bool]:
    """Hash in each stream (names kept, names replaced, all kept), and whether the
    word is a slot there; hash 0 for a word without a letter or digit."""
    bare = word.strip(_EDGE)
    if not bare:
        return 0, 0, 0, False, False, False
    low = bare.lower()
    h = xxhash.xxh64_intdigest(low) | 1
    if bare[0].isdigit() and _NUMBER.fullmatch(low):
        return _SLOT["num"], _SLOT["num"], h, True, True, False
    if low in UNITS:
        return _SLOT["unit"], _SLOT["unit"], h, True, True, False
    named = bare[0].isupper()
    return h, _SLOT["name"] if named else h, h, False, named, False


class _Words(dict):
    """word -> its row in ``hashes`` and ``slots`` (a value for each stream, row by
    row); each distinct word is canonicalised once, until ``most`` words are known."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self.hashes, self.slots = array("Q"), bytearray()

    def clear(self) -> None:
        super().clear()
        self.hashes, self.slots = array("Q"), bytearray()

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        found = canonical(word)
        self.hashes.extend(found[:STREAMS])
        self.slots.extend(found[STREAMS:])
        return at

    def canon(self, texts: list[str | None]):
        """All words of the texts in one list, the places of those kept, and of each
        of these its text, hashes and slots. Words without a letter or digit
        aren't kept."""
        if len(self) > self.most:
            self.clear()
        rows = [(t or "").split() for t in texts]
        words = list(chain.from_iterable(rows))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        hashes, slots = np.array(self.hashes, np.uint64).reshape(-1, STREAMS), np.array(self.slots, bool).reshape(-1, STREAMS)
        keep = np.flatnonzero(hashes[:, 0].take(at))
        at = at[keep]
        return words, keep, of[keep], hashes.take(at, 0), slots.take(at, 0)


_KNOWN = _Words()


def _salt(stream: int, length: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{stream}/{length}"))


def _windows(hashes: np.ndarray, lengths: list[int], stream: int):
    """For each length, ascending: it and the hash of the window that starts at each
    place. A window's sum goes on from that of the shorter one at its place."""
    sums, done = np.zeros(len(hashes), np.uint64), 0
    for length in lengths:
        n = max(0, len(hashes) - length + 1)
        sums = sums[:n]
        for k in range(done, length):
            sums = sums * _M
            sums += hashes[k:n + k]
        done = length
        h = sums >> np.uint64(31)
        h ^= sums
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += _salt(stream, length)
        h ^= h >> np.uint64(29)
        yield length, h


def _slots(words, keep, slots, at, length):
    return [words[keep[k]].strip(_EDGE).lower() for k in range(at, at + length) if slots[k]]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, stream, length, h, at, values): the windows of each item. A
    window needs a word that is no slot in half of its places, which windows of
    the verbatim stream always have."""
    def rows(batches):
        for b in batches:
            out = []
            for item, text in zip(b["item_id"], b["text"]):
                words, keep, _, table, slots = _KNOWN.canon([text])
                length = min(WINDOW, len(keep))
                if length < SHORTEST:
                    continue
                for stream in range(STREAMS):
                    (_, found), = _windows(table[:, stream], [length], stream)
                    for at, h in enumerate(found.view(np.int64).tolist()):
                        if 2 * int(slots[at:at + length, stream].sum()) <= length:
                            out.append((item, stream, length, h, at, _slots(words, keep, slots[:, stream], at, length)))
            yield pd.DataFrame(out, columns=["item_id", "stream", "length", "h", "at", "vals"])

    return benchmark.select("item_id", "text").mapInPandas(rows, "item_id long, stream int, length int, h long, at int, vals array<string>")


def _passed(h: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of the hashes that both halves of the filter let through; the second
    half is asked for those only that passed the first."""
    at = np.flatnonzero(high[(h >> np.uint64(64 - FILTER_BITS)).view(np.int64)])
    return at[low[(h[at] & np.uint64((1 << FILTER_BITS) - 1)).view(np.int64)]]


def _consistent(w):
    """Those windows of a diagonal whose slot values go one to one over the
    whole diagonal: of pairs that clash, the one in more windows stays (then the
    lesser). A window copied word for word stays in any case."""
    every = F.flatten(F.transform(w, lambda x: x["pairs"]))
    counted = F.transform(F.array_distinct(every), lambda p: F.struct(
        F.size(F.filter(every, lambda q: q == p)).alias("n"), p["vals"].alias("vals"), p["own"].alias("own")))

    def clash(p, q):
        more = (q["n"] > p["n"]) | ((q["n"] == p["n"]) & (F.struct(q["vals"], q["own"]) < F.struct(p["vals"], p["own"])))
        return ((p["vals"] == q["vals"]) != (p["own"] == q["own"])) & more

    lost = F.transform(F.filter(counted, lambda p: F.exists(counted, lambda q: clash(p, q))), lambda p: F.struct(p["vals"].alias("vals"), p["own"].alias("own")))
    return F.filter(w, lambda x: F.forall(x["pairs"], lambda p: p["vals"] == p["own"]) | ~F.arrays_overlap(x["pairs"], lost))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, first_word, n_slots): one row for
    each document and benchmark item that it holds."""
    windows = stage(benchmark_windows(benchmark), "bench-windows")
    high, low = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << FILTER_BITS, bool)
    mask = (1 << FILTER_BITS) - 1
    places = windows.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("p"), F.lit(0).alias("k")).unionAll(
        windows.select(F.col("h").bitwiseAND(F.lit(mask)).alias("p"), F.lit(1).alias("k"))).distinct()
    got = places.toPandas()  # at most 2 x 2^22 places
    high[got["p"][got["k"] == 0]] = True
    low[got["p"][got["k"] == 1]] = True
    packed = np.packbits(high).tobytes(), np.packbits(low).tobytes()
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # 3 to 8

    def survivors(batches):
        hi, lo = (np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in packed)
        for b in batches:
            texts = b.column("_t").to_pylist()
            ids, marks = b.column("_d").to_pylist(), b.column("_h").to_pylist()
            for begin, end in slices(texts):
                out = []
                words, keep, of, table, slots = _KNOWN.canon(texts[begin:end])
                first = np.searchsorted(of, np.arange(end - begin))
                for stream in range(STREAMS):
                    for length, h in _windows(np.ascontiguousarray(table[:, stream]), lengths, stream):
                        found = _passed(h, hi, lo)
                        # windows of one text only
                        for at in found[of[found] == of[found + length - 1]].tolist():
                            i = int(of[at])
                            out.append((ids[begin + i], marks[begin + i], stream, int(h[at].view(np.int64)), at - int(first[i]), _slots(words, keep, slots[:, stream], at, length)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())))],
                        ["doc_id", "text_hash", "stream", "h", "place", "own"])

    found = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), F.col("text").alias("_t")) \
        .mapInArrow(survivors, "doc_id long, text_hash long, stream int, h long, place int, own array<string>")
    pairs = F.array_distinct(F.arrays_zip("vals", "own"))
    consistent = (F.size(F.array_distinct(F.col("pairs.vals"))) == F.size("pairs")) & \
        (F.size(F.array_distinct(F.col("pairs.own"))) == F.size("pairs"))
    joined = found.distinct().join(windows, ["stream", "h"]).where(F.size("vals") == F.size("own"))
    fit = joined.withColumn("pairs", pairs).where(consistent)
    # a diagonal has a window for each place of the item at most
    per = fit.groupBy("doc_id", "text_hash", "item_id", "stream", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set(F.struct("at", "place", "pairs")).alias("w"))
    total = windows.groupBy("item_id", "stream").agg(F.countDistinct("at").alias("of"))
    enough = F.least(F.lit(RUN), F.col("of"))
    held = per.join(total, ["item_id", "stream"]).where(F.size("w") >= enough) \
        .withColumn("w", _consistent(F.col("w"))).where(F.size("w") >= enough) \
        .select("doc_id", "text_hash", "item_id", F.size("w").cast("long").alias("n"), F.array_min(F.transform("w", lambda x: x["place"])).alias("first"),
                F.array_distinct(F.flatten(F.transform("w", lambda x: x["pairs"]))).alias("pairs"))
    return held.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n").alias("n_windows"), F.min("first").alias("first_word"), F.max(F.size("pairs")).alias("n_slots"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    held = stage(matches(docs, benchmark).select("doc_id", "text_hash").distinct().toDF("_d", "_h"), "contaminated")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["_d"]) & (F.xxhash64(docs["text"]) == held["_h"]), "left_anti")

"""Operator 10, suffix-array deduplication of repeated byte strings.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (a
smaller doc_id, or the same document and an earlier start) is removed; strings
never cross documents and are judged on the input.

1. Text that can't repeat is never sorted. Each 100-byte string has one anchor,
   its ``GRAM``-byte piece of least hash; strings in a row with the same anchor
   make a fragment. Strings that are equal have equal anchors at the same place,
   so a fragment whose anchor occurs once in the corpus holds nothing repeated.
2. Equal fragments are one class, sorted once: all its members but the first are
   repeats as a whole. An anchor with a single class needs no more.
3. The fragments of the other classes go through a suffix array built by the
   difference-cover algorithm: sort the triples at sampled places, recurse on
   their names, merge in the remaining suffixes. Adjacent suffixes are compared
   over their first 100 bytes; of each run of equal ones the earliest stays. All
   classes of an anchor are in one task, many anchors to a task. The recursion
   ends when names span 100 bytes, as longer prefixes don't matter.
4. An anchor with more than ``MOST`` classes (a passage in many contexts) would
   be an unbounded group. Its strings are dealt out by the whole string instead
   and the earliest of each is found by an aggregate: an exact way for the rest.

Anchors and classes are told apart by 64-bit hashes (a class by those of its
anchor and of its bytes), strings of step 4 by 128 bits, texts of one doc_id by
a 64-bit hash of their own.

Defined results: null text is empty; a null doc_id comes first; rows of one
doc_id are ordered by a hash of their text, and rows that are equal in both are
one document, each with the same result; documents under 100 bytes keep all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import stage, unstage

LENGTH = 100
GRAM = 32
MOST = 2000  # classes of an anchor that a task sorts together
BATCH = 1_200_000  # bytes that a suffix array is built over; names must stay under 2**21

_CHUNK = 1 << 18
_M = 0x9E3779B97F4A7C15
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
_TABLE = ((_TABLE ^ (_TABLE >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(_CHUNK + 2 * LENGTH, base, np.uint64)])


_POW, _INV = _powers(_M), _powers(pow(_M, -1, 1 << 64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` elements in a row, by doubling."""
    y, n, s = x, len(x) - width + 1, 1
    while 2 * s <= width:
        y = np.minimum(y[:-s], y[s:])
        s *= 2
    return np.minimum(y[:n], y[width - s:width - s + n])


def fragments(data: np.ndarray, ends: np.ndarray):
    """Fragments of documents laid end to end in ``data``; ``ends`` are their
    ends. Yields arrays (document, start in data, length, anchor hash, class
    hash), a chunk of start places at a time."""
    width, total = LENGTH - GRAM + 1, len(data)
    for lo in range(0, max(0, total - LENGTH + 1), _CHUNK):
        part = data[lo:lo + _CHUNK + LENGTH - 1]
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[part] * _POW[:len(part)])]
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _INV[:len(part) - GRAM + 1])
        low = np.uint64((1 << 20) - 1)
        # the leftmost least: the place takes the low bits
        anchor = (_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low).astype(np.int64)
        doc = np.searchsorted(ends, lo + np.arange(len(anchor)), "right")
        inside = lo + np.arange(len(anchor)) + LENGTH <= ends[doc]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[new[1:], len(anchor)] - 1
        new, last = new[inside[new]], last[inside[new]]
        size = last - new + LENGTH
        whole = _mix((sums[new + size] - sums[new]) * _INV[new]) + _mix((size << 8 | anchor[new] - new).astype(np.uint64) * np.uint64(_M))
        yield doc[new], lo + new, size, grams[anchor[new]].view(np.int64), whole.view(np.int64)


def _joined(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array laid end to end, and the texts' ends."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset:]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """_d: the doc_id for comparing, _k: 64-bit hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63) + 1)).alias("_d"),
                       F.xxhash64(text.cast("binary")).alias("_k"), F.col("doc_id"), text.alias("_t"))


def _find(batches):
    for b in batches:
        data, ends = _joined(b.column("_t"))
        begins = np.r_[0, ends[:-1]]
        ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_k"))
        for doc, at, size, anchor, whole in fragments(data, ends):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (anchor, whole, ids[doc], keys[doc], at - begins[doc], size.astype(np.int32))], ["g", "e", "_d", "_k", "place", "size"])


def _cut(batches):
    """Documents with their wanted fragments -> the fragments with bytes."""
    for b in batches:
        data, ends = _joined(b.column("_t"))
        begins = np.r_[0, ends[:-1]]
        wanted = b.column("wanted")
        n = np.diff(wanted.offsets.to_numpy())
        rows = wanted.flatten()
        doc = np.repeat(np.arange(len(n)), n)
        place, size = rows.field("place").to_numpy(), rows.field("size").to_numpy().astype(np.int64)
        start = begins[doc] + place
        take = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
        ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_k"))
        yield pa.RecordBatch.from_arrays([rows.field("g"), pa.array(ids[doc]), pa.array(keys[doc]), pa.array(place), rows.field("many"), text],
                                         ["g", "_d", "_k", "place", "many", "bytes"])


# ------------------------------------------------------------- suffix array

def suffix_order(s: np.ndarray, depth: int = LENGTH, span: int = 1) -> np.ndarray:
    """Places of ``s`` (numbers from 0, below 2**21) in the order of their
    suffixes, by the difference cover {1, 2} mod 3. Suffixes that agree over
    ``depth`` are in any order. ``span``: bytes that a number of ``s`` stands for.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    pad = np.r_[s.astype(np.int64) + 1, 0, 0, 0, 0]
    # sort the triples at the sampled places, and name them in order
    n1 = np.arange(1, n + (n % 3 == 1), 3)  # one more if it keeps the two halves apart
    sample = np.r_[n1, np.arange(2, n, 3)]
    triple = (pad[sample] << 42) | (pad[sample + 1] << 21) | pad[sample + 2]
    by = np.argsort(triple, kind="stable")
    name = np.zeros(len(sample), np.int64)
    name[by] = np.cumsum(np.r_[0, np.diff(triple[by]) != 0])
    if len(by) and name[by[-1]] + 1 < len(sample) and 3 * span < depth:
        by = suffix_order(name, depth, 3 * span)  # recurse on the names
        name = np.zeros(len(sample), np.int64)
        name[by] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name + 1
    # the remaining suffixes: their first number, then the sampled suffix after it
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((pad[rest] << 21) | rank[rest + 1], kind="stable")]
    # merge: both kinds of sampled suffix compare with them by numbers and ranks
    order = sample[by]
    order = order[order < n]
    one = order % 3 == 1
    key = lambda i, k: (pad[i] << 21 | rank[i + 1]) if k == 1 else (pad[i] << 42 | pad[i + 1] << 21 | rank[i + 2])
    place = np.arange(len(order))
    place[one] += np.searchsorted(key(rest, 1), key(order[one], 1), "right")
    place[~one] += np.searchsorted(key(rest, 2), key(order[~one], 2), "right")
    among = np.arange(len(rest)) + np.searchsorted(key(order[one], 1), key(rest, 1)) + np.searchsorted(key(order[~one], 2), key(rest, 2))
    both = np.r_[order, rest]
    return both[np.argsort(np.r_[place, among], kind="stable")]


def equal_runs(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each of ``starts`` (ascending places of ``text``, 0 between
    fragments), equal where the next LENGTH bytes are equal."""
    wanted = np.full(len(text), -1)
    wanted[starts] = np.arange(len(starts))
    order = wanted[suffix_order(text)]
    order = order[order >= 0]
    at = starts[order]
    same = np.zeros(len(at), bool)
    reach = np.arange(LENGTH)
    for lo in range(1, len(at), 50_000):  # adjacent prefixes
        a, b = at[lo - 1:lo + 49_999], at[lo:lo + 50_000]
        same[lo:lo + len(b)] = (text[a[:len(b), None] + reach] == text[b[:, None] + reach]).all(1)
    run = np.zeros(len(starts), np.int64)
    run[order] = np.cumsum(~same)
    return run


def _strings(sizes: np.ndarray):
    """Fragment and offset of each of their 100-byte strings."""
    n = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def repeated_in(parts: list[bytes], ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset) of the strings that also start earlier."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int64)
    text[np.cumsum(sizes + 1) - 1] = 0
    # bytes are 1 to 256, so that the end of a fragment is below all
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    text[inside] += 1
    of, offset = _strings(sizes)
    run = equal_runs(text, (np.cumsum(sizes + 1) - sizes - 1)[of] + offset)
    order = np.lexsort((places[of] + offset, keys[of], ids[of], run))
    again = order[np.r_[False, run[order][1:] == run[order][:-1]]] if len(order) else order
    return of[again], offset[again]


def _spans(of: np.ndarray, offset: np.ndarray, ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Strings in a row of one fragment become one span."""
    order = np.lexsort((offset, of))
    of, offset = of[order], offset[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(of) else of
    last = np.r_[new[1:], len(of)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[of[new]]), pa.array(keys[of[new]]), pa.array(places[of[new]] + offset[new]),
         pa.array((offset[last] - offset[new] + LENGTH).astype(np.int32))], ["_d", "_k", "place", "size"])


def _sorted_groups(batches):
    """One row for each anchor, with all its classes -> repeated spans."""
    for b in batches:
        groups = b.column("classes")
        rows = groups.flatten()
        ids, keys, places = (rows.field(c).to_numpy() for c in ("_d", "_k", "place"))
        parts = rows.field("bytes").to_pylist()
        edges = groups.offsets.to_numpy() - groups.offsets[0].as_py()
        bytes_to = np.r_[0, np.cumsum([len(p) + 1 for p in parts])][edges]
        lo = 0
        while lo < len(groups):
            hi = max(lo + 1, int(np.searchsorted(bytes_to, bytes_to[lo] + BATCH, "right")) - 1)
            x, y = edges[lo], edges[hi]
            yield _spans(*repeated_in(parts[x:y], ids[x:y], keys[x:y], places[x:y]), ids[x:y], keys[x:y], places[x:y])
            lo = hi


def _each_string(batches):
    """Fragments of anchors with many classes -> a row for each string."""
    for b in batches:
        ids, keys, places, parts = *(b.column(c).to_numpy() for c in ("_d", "_k", "place")), b.column("bytes").to_pylist()
        of, offset = _strings(np.array([len(p) for p in parts], np.int64))
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(parts[f][o:o + LENGTH]) for f, o in zip(of.tolist(), offset.tolist())), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(ids[of]), pa.array(keys[of]), pa.array(places[of] + offset)], ["h1", "h2", "_d", "_k", "place"])


# ----------------------------------------------------------------- operator

def _by_document(rows: DataFrame) -> DataFrame:
    """(_d, _k, place, size) -> (_d, _k, spans) with the spans of each document."""
    return rows.groupBy("_d", "_k").agg(F.collect_list(F.struct(F.col("place").alias("start"), "size")).alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_d, _k, spans): the repeated strings of each document that has any, as
    spans (start, size) that may overlap.

    Each step is written and its inputs deleted when no later step reads them,
    so the disk holds one step's shuffle at a time."""
    texts = _keyed(docs)
    found = texts.select("_d", "_k", "_t").mapInArrow(_find, "g long, e long, _d long, _k long, place long, size int")
    often = stage(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "anchors")
    rows = stage(found.join(often.hint("shuffle_hash"), "g"), "fragments")
    unstage(often)
    classes = rows.groupBy("g", "e").agg(F.min(F.struct("_d", "_k", "place")).alias("first"), F.first("size").alias("size"))
    classes = stage(classes.select("g", "e", "first._d", "first._k", "first.place", "size"), "classes")
    # members of a class, but for its first
    heads = classes.select("g", "e", F.col("_d").alias("_fd"), F.col("_k").alias("_fk"), F.col("place").alias("_fp"))
    members = rows.join(heads, ["g", "e"]).where("_d <> _fd OR _k <> _fk OR place <> _fp").select("_d", "_k", "place", "size")
    members = stage(_by_document(members), "member-spans")
    unstage(rows)
    # anchors with more than one class: the fragments' bytes, from the texts
    many = classes.groupBy("g").agg(F.count("*").alias("many")).where("many > 1")
    wanted = classes.join(many, "g").groupBy("_d", "_k") \
        .agg(F.collect_list(F.struct("g", "place", "size", "many")).alias("wanted"))
    left = texts.select("_d", "_k", "_t")
    cut = stage(left.join(wanted, ["_d", "_k"]).select("_d", "_k", "_t", "wanted").mapInArrow(
        _cut, "g long, _d long, _k long, place long, many long, bytes binary").distinct(), "class-bytes")
    unstage(classes)
    sorted_ = cut.where(F.col("many") <= MOST).groupBy("g").agg(F.collect_list(F.struct("_d", "_k", "place", "bytes")).alias("classes")) \
        .select("classes").mapInArrow(_sorted_groups, "_d long, _k long, place long, size int")
    strings = cut.where(F.col("many") > MOST).select("_d", "_k", "place", "bytes").mapInArrow(_each_string, "h1 long, h2 long, _d long, _k long, place long")
    first = strings.groupBy("h1", "h2").agg(F.min(F.struct("_d", "_k", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = strings.join(first, ["h1", "h2"]).where("_d <> first._d OR _k <> first._k OR place <> first.place") \
        .select("_d", "_k", "place", F.lit(LENGTH).alias("size"))
    others = stage(_by_document(sorted_.unionAll(again)), "class-spans")
    unstage(cut)
    return members.unionAll(others).groupBy("_d", "_k").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end in bytes, maximal), kept
    (the bytes that stay) for every row of ``docs``."""
    spans = repeated_spans(docs)
    texts = _keyed(docs)
    both = texts.join(spans, ["_d", "_k"], "left").select("doc_id", "_t", "spans")

    def cut(batches):
        for b in batches:
            data, ends = _joined(b.column("_t"))
            begins = np.r_[0, ends[:-1]]
            spans = b.column("spans")
            n = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
            rows = spans.flatten()
            n = np.where(spans.is_null().to_numpy(zero_copy_only=False), 0, n)
            doc = np.repeat(np.arange(len(n)), n)
            start = begins[doc] + rows.field("start").to_numpy()
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, start, 1)
            np.add.at(step, np.minimum(start + rows.field("size").to_numpy(), ends[doc]), -1)
            gone = np.cumsum(step[:-1]) > 0
            sizes = np.add.reduceat(np.r_[~gone, False], begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
            sizes[ends == begins] = 0
            kept = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())])
            # runs of removed bytes, cut at the documents' edges
            edge = np.zeros(len(data) + 1, bool)
            edge[begins] = True
            on = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | edge[:-1]))
            off = np.flatnonzero(gone & (np.r_[~gone[1:], True] | edge[1:])) + 1
            of = np.searchsorted(ends, on, "right")
            removed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(n)))], pa.int32()), pa.StructArray.from_arrays(
                [pa.array(on - begins[of]), pa.array(off - begins[of])], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ends - begins), removed, kept.cast(pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

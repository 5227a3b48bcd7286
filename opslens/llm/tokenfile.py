"""Operator 4, token-ID output: an adaptive context-mixing range coder.

A document's ids are written, documents in ascending doc_id order, into blocks
that start from an empty model and carry a checksum, so that any block can be
read alone and damage stays inside one block.

Within a block the ids are cut into lanes that are coded in step, one id of
each lane at a time, over one shared model; numpy does the arithmetic of all
lanes at once. The model predicts the next id from the last two ids (order 2),
the last id (order 1) and the ids' frequencies so far (order 0). The predictions
are mixed with weights learned for each joint state of confidence of the two
contexts, and the mixture's interval narrows the lane's range coder.

Files are a table with one row for each block (part, seq, n_ids, block); the
``block`` bytes are the format:

    magic 4s | n_docs, n_ids, alphabet, lanes, words, crc32 of the ids: 6 x u32
    doc_ids i64[n_docs] | null flags u8[n_docs] | lengths u32[n_docs]
    words of each lane u32[lanes] | words u16[words] | crc32 of all before: u32

Defined results: null text is an empty one (its only id is the end id); a null
doc_id sorts first; repeated rows are written each, in the order of their text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from codecs import charmap_decode

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import stage

END_ID = 2
MAGIC = b"CMR1"
BLOCK_IDS = 1 << 20
_HEAD = struct.Struct("<4s6I")
_BLOCKS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("block", pa.binary())])
_U = np.uint64
_TOP, _LEAST, _SHIFT, _ALL = _U(1 << 48), _U(1 << 40), _U(16), _U(0xFFFFFFFFFFFFFFFF)
_REFRESH = 32  # steps between two looks at the counts
_LIMIT = 1 << 23  # counts are halved beyond this sum


class _Mixer:
    """The adaptive model, the same on both sides.

    A context's guess and the confidence in it (0 to 7) are one number,
    ``guess << 3 | confidence``. Outcomes are 0: order 2 was right, 1: order 1
    was, 2: neither, which leaves the id to order 0.
    """

    def __init__(self, alphabet: int):
        n = self.alphabet = alphabet
        self.count = np.zeros(n, np.int64)
        self.state1, self.state2 = np.full(n, n << 3, np.int32), np.full(1 << 18, n << 3, np.int32)
        # outcomes by (confidence 2, confidence 1, both say the same)
        self.seen = np.tile(np.array([1, 1, 6], np.int64), (128, 1))
        self.steps = 0
        # ids and outcomes since the last refresh, which alone reads the counts
        self.ids, self.outcomes = [], []
        self.firsts = None

    def refresh(self) -> None:
        if self.steps % _REFRESH == 0 or self.steps < 4:
            if self.ids:
                self.count += np.bincount(np.concatenate(self.ids), minlength=self.alphabet)
                self.seen += np.bincount(np.concatenate(self.outcomes), minlength=384).reshape(128, 3)
                self.ids, self.outcomes = [], []
            freq = self.count * 24 + 1
            if int(freq.sum()) > _LIMIT:
                self.count >>= 1
                freq = self.count * 24 + 1
            self.freq = freq.view(_U)
            # the sums, with the total at the end
            self.cum = np.zeros(self.alphabet + 1, _U)
            np.cumsum(self.freq, out=self.cum[1:])
            self.total = self.cum[self.alphabet]
            self.firsts = None
            w = (self.seen * 65000 // self.seen.sum(1, keepdims=True)).clip(48)
            w[1::2, 1] = 0  # the same guess twice is coded as that of order 2
            w[:, 2] = 65536 - w[:, 0] - w[:, 1]
            self.share = w.ravel().astype(_U)
            self.begin = (np.cumsum(w, 1) - w).ravel().astype(_U)
            if int(self.seen.max()) > 1 << 20:
                self.seen = (self.seen >> 1) + 1
        self.steps += 1

    def look(self, a: np.ndarray, b: np.ndarray) -> None:
        """Predictions after the ids a, b."""
        self.b = b
        self.slot = ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & 0x3FFFF
        s2, s1 = self.s2, self.s1 = self.state2.take(self.slot), self.state1.take(b)
        self.g2, self.g1 = s2 >> 3, s1 >> 3
        self.cell = _CELL.take((s2 & 7) << 4 | (s1 & 7) << 1 | (self.g1 == self.g2))

    def symbol(self, v: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds v. Values go in slices of equal
        width to the id at the slice's begin; a search finds what lies behind it."""
        if self.firsts is None:
            self.cut = _U(max(0, int(self.total).bit_length() - 16))
            ends = (self.cum[1:] - _U(1) >> self.cut).view(np.int64) + 1
            self.firsts = np.repeat(np.arange(self.alphabet), np.diff(ends, prepend=0))
        x = self.firsts.take((v >> self.cut).view(np.int64))
        behind = np.flatnonzero(self.cum.take(x + 1) <= v)
        x[behind] = np.searchsorted(self.cum, v.take(behind), "right") - 1
        return x

    def learn(self, x: np.ndarray, outcome: np.ndarray) -> None:
        """``outcome`` is the cell's number plus the outcome in it."""
        self.ids.append(x)
        self.outcomes.append(outcome)
        other = (x << 3).astype(np.int32)
        for state, at, now, change, anew in ((self.state2, self.slot, self.s2, _CHANGE2, _ANEW2), (self.state1, self.b, self.s1, _CHANGE1, _ANEW1)):
            now += change.take(outcome)
            np.copyto(now, other, where=anew.take(outcome))
            state[at] = now


def _changes() -> list[np.ndarray]:
    """By cell and outcome, for order 2 and for order 1: how the confidence
    changes, and whether the id just met becomes the guess."""
    sure2, sure1, same, outcome = np.indices((8, 8, 2, 3)).reshape(4, -1)
    out = []
    for sure, hit in ((sure2, outcome == 0), (sure1, (outcome == 1) | (outcome == 0) & (same == 1))):
        out += [np.where(hit, np.minimum(sure + 1, 7), sure >> 1) - sure, ~hit & (sure < 2)]
    return [x.astype(np.int32) if x.dtype != bool else x for x in out]


_CELL = np.arange(0, 384, 3)  # where a cell's three outcomes begin
_MISS = np.tile([False, False, True], 128)
_CHANGE2, _ANEW2, _CHANGE1, _ANEW1 = _changes()


def _lanes(n: int) -> int:
    return max(1, min(2048, n // 512))


def _unsettled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which lanes must shift out 16 bits; narrows a range that is short but
    lies across a settled boundary."""
    top = (low ^ (low + width)) < _TOP
    short = np.flatnonzero(width < _LEAST)
    if len(short):
        short = short[~top[short]]
        width[short] = (~low[short] + _U(1)) & (_LEAST - _U(1))
        top[short] = True
    return top


def _unsettled_at(low: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_unsettled`` for the lanes ``at`` of all."""
    wi = width.take(at)
    top = _unsettled(low.take(at), wi)
    width[at] = wi
    return top


def code(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids -> (words of each lane, 16-bit words, lane by lane)."""
    n, lanes = len(ids), _lanes(len(ids))
    length = -(-n // lanes) if n else 0
    mix = _Mixer(alphabet)
    low, width = np.zeros(lanes, _U), np.full(lanes, _ALL)
    a, b, lane0 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.arange(lanes) * length
    out_lane, out_word = [], []

    def put(at, words):
        out_lane.append(at.astype(np.uint16))
        out_word.append(words.astype(np.uint16))

    for t in range(length):
        m = min(lanes, -(-(n - t) // length))
        x = ids.take(lane0[:m] + t).astype(np.int64)
        mix.refresh()
        mix.look(a[:m], b[:m])
        cell = (2 - (x == mix.g1)) * (x != mix.g2) + mix.cell
        lo, wi = low[:m], width[:m]
        wi >>= _SHIFT
        lo += mix.begin.take(cell) * wi
        wi *= mix.share.take(cell)
        miss = np.flatnonzero(_MISS.take(cell))
        r, y = wi.take(miss) // mix.total, x.take(miss)
        lo[miss] = lo.take(miss) + mix.cum.take(y) * r
        wi[miss] = mix.freq.take(y) * r
        # about half of the lanes shift once, which all do together; few shift again
        top = _unsettled(lo, wi)
        at = np.flatnonzero(top)
        put(at, lo.take(at) >> _U(48))
        by = top * _SHIFT
        lo <<= by
        wi <<= by
        at = at[_unsettled_at(lo, wi, at)]
        while len(at):
            put(at, lo[at] >> _U(48))
            lo[at] <<= _SHIFT
            wi[at] <<= _SHIFT
            at = at[_unsettled_at(lo, wi, at)]
        mix.learn(x, cell)
        a, b = b[:m], x
    for k in range(4):
        put(np.arange(lanes), low >> _U(48 - 16 * k) & _U(0xFFFF))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    return np.bincount(lane, minlength=lanes).astype(np.uint32), word[np.argsort(lane, kind="stable")]


def decode(n: int, alphabet: int, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids that ``code`` gave these words for."""
    lanes = len(sizes)
    length = -(-n // lanes) if n else 0
    mix, out = _Mixer(alphabet), np.zeros((length, lanes), "<u4")
    # past: how far the value read is past the low end
    low, width, past = np.zeros(lanes, _U), np.full(lanes, _ALL), np.zeros(lanes, _U)
    words = np.r_[words, np.zeros(8, np.uint16)].astype(np.uint16)
    place = np.r_[0, np.cumsum(sizes.astype(np.int64))[:-1]]
    for _ in range(4):
        past = past << _SHIFT | words[place]
        place += 1
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(length):
        m = min(lanes, -(-(n - t) // length))
        mix.refresh()
        mix.look(a[:m], b[:m])
        low, width, past, place = low[:m], width[:m], past[:m], place[:m]
        width >>= _SHIFT
        # where the outcomes 1 and 2 begin
        not0 = past >= mix.share.take(mix.cell) * width
        not01 = past >= mix.begin.take(mix.cell + 2) * width
        cell = mix.cell + not0 + not01
        move = mix.begin.take(cell) * width
        low += move
        past -= move
        width *= mix.share.take(cell)
        x = np.where(not0, mix.g1, mix.g2).astype(np.int64)
        miss = np.flatnonzero(not01)
        r, v = width.take(miss) // mix.total, past.take(miss)
        y = mix.symbol(np.minimum(v // r, mix.total - _U(1)))
        x[miss] = y
        move = mix.cum.take(y) * r
        low[miss] = low.take(miss) + move
        past[miss] = v - move
        width[miss] = mix.freq.take(y) * r
        top = _unsettled(low, width)
        at = np.flatnonzero(top)
        by = top * _SHIFT
        low <<= by
        width <<= by
        past <<= by
        past[at] = past.take(at) | words.take(place.take(at))
        place += top
        at = at[_unsettled_at(low, width, at)]
        while len(at):
            past[at] = past[at] << _SHIFT | words.take(place[at])
            place[at] += 1
            low[at] <<= _SHIFT
            width[at] <<= _SHIFT
            at = at[_unsettled_at(low, width, at)]
        mix.learn(x, cell)
        out[t, :m] = x
        a, b = b[:m], x
    return out.T.ravel()[:n]


def write_block(doc_ids: list, lists: list[np.ndarray]) -> bytes:
    """One block of whole documents. doc_ids may hold None; lists are u4 ids."""
    ids = np.concatenate([*lists, np.zeros(0, "<u4")]).astype("<u4")
    alphabet = int(ids.max()) + 1 if len(ids) else 1
    sizes, words = code(ids, alphabet)
    body = _HEAD.pack(MAGIC, len(lists), len(ids), alphabet, len(sizes), len(words), zlib.crc32(ids.tobytes()))
    body += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    body += np.array([len(x) for x in lists], "<u4").tobytes() + sizes.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list, list[np.ndarray]]:
    """doc_ids and ids of a block; raises ValueError if a checksum is wrong."""
    if len(block) < _HEAD.size + 4 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("block checksum does not match")
    magic, docs, n, alphabet, lanes, words, crc = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = _HEAD.size

    def take(kind, count):
        nonlocal at
        got = np.frombuffer(block, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    sizes, data = take("<u4", lanes), take("<u2", words)
    ids = decode(n, alphabet, sizes, data).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("ids checksum does not match")
    ends = np.cumsum(lengths.astype(np.int64))
    return [None if z else int(d) for d, z in zip(doc_ids, null)], [ids[e - k:e] for e, k in zip(ends, lengths)]


# -------------------------------------------------------------- tokenizing

class _Vocabulary(dict):
    """word -> its ids, from a tokenizer file, with a short way for plain words.

    Letters up to U+017F, then ASCII punctuation (but no apostrophe, which may
    begin a contraction, and no <, which may begin a special token), need no
    normalizing but lower case, and are split before the punctuation: the
    letters go straight to the tokenizer's model, in its byte alphabet. All
    other words go through the whole tokenizer.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:;=-@[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.tails: dict[str, list[int]] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # byte -> its letter in the byte alphabet, from those of the two bytes of U+0080 to U+017F
        letters = {y: z for c in range(0x80, 0x180) for y, z in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0])}
        self.bytes = "".join(letters.get(y, chr(y)) for y in range(256))

    def __missing__(self, word: str) -> bytes:
        """Little-endian u4 ids of a word that isn't known yet."""
        found = self.old.pop(word, None)
        if found is None:
            tail = ""
            if word.isascii() and word.isalpha():
                plain = word
            elif m := self.PLAIN.fullmatch(word):
                plain, tail = m.groups()
            else:
                plain = None
            if plain:
                plain = plain.lower()
                if not plain.isascii():
                    plain = charmap_decode(plain.encode(), "strict", self.bytes)[0]
                ids = [x.id for x in self.model.tokenize(plain)]
                if tail:
                    if tail not in self.tails:
                        self.tails[tail] = self.whole.encode(tail, add_special_tokens=False).ids
                    ids += self.tails[tail]
            else:
                ids = self.whole.encode(word, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
        self[word] = found
        return found

    def age(self) -> None:
        """Lets go of what was not met since the last call."""
        self.old = dict(self)
        self.clear()


_LOADED: dict[str, _Vocabulary] = {}
_BYTES = pa.large_binary()
# _Vocabulary.PLAIN for Arrow, a word's letters and its tail
_PARTS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-įı-ſ]+)(?P<tail>[!-&(-/:;=-@\[-`{-~]*)$"


def _token_ids(path: str, texts: pa.Array, most: int = 400_000):
    """Runs of ids of whole texts, with the end id: (u4 ids, how many each text has).

    The vocabulary drops white space and never joins over it, so a text's ids
    are those of its words in turn. Arrow finds the distinct words of a run and
    cuts plain ones into lower-case letters and punctuation; each distinct part
    goes through the tokenizer once and is then kept; beyond ``most`` parts, those
    that were not met again are let go. Arrow then lines up the words' ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = _Vocabulary(path)
    known = _LOADED[path]
    for lo, hi in _runs(texts):
        if len(known) > most:
            known.age()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.slice(lo, hi - lo), ""), "\n", " "), " ")
        words = pc.dictionary_encode(lists.flatten())
        cut = pc.extract_regex(words.dictionary, _PARTS)
        first = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "letters")), words.dictionary)
        parts = pc.dictionary_encode(pa.concat_arrays([first, pc.fill_null(pc.struct_field(cut, "tail"), "")]))
        found = [known[x] for x in parts.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ids, n = pa.array(found, _BYTES), len(words.dictionary)
        # each distinct word's first part and tail, and at the end a word of the end id alone
        ids = pc.binary_join_element_wise(ids.take(parts.indices[:n]), ids.take(parts.indices[n:]), pa.scalar(b"", _BYTES))
        ids = pa.concat_arrays([ids, pa.array([struct.pack("<I", END_ID)], _BYTES)])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        at = pa.array(np.insert(words.indices.to_numpy(), ends, n))
        del lists, words, cut, first, parts, found
        _, offsets, data = ids.take(at).buffers()
        ends = np.frombuffer(offsets, np.int64)[ends + np.arange(1, len(ends) + 1)] // 4
        yield np.frombuffer(data, "<u4", ends[-1]), np.diff(ends, prepend=0)


def _runs(texts: pa.Array, most: int = 8_000_000) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def write_ids(docs: DataFrame, tokenizer_path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the blocks; the written table
    (part, seq, n_ids, block), parts ascending with doc_id."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id") \
        .sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        part, seq, doc_ids, lists, size = TaskContext.get().partitionId(), 0, [], [], 0

        def done():
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_ids": [size], "block": [write_block(doc_ids, lists)]}, _BLOCKS)

        for b in batches:
            ids, first = b["doc_id"].to_pylist(), 0
            for found, sizes in _token_ids(tokenizer_path, b["text"]):
                ends = np.cumsum(sizes)
                for d, end, n in zip(ids[first:], ends.tolist(), sizes.tolist()):
                    doc_ids.append(d)
                    lists.append(found[end - n:end])
                    size += n
                    if size >= block_ids:
                        yield done()
                        seq, doc_ids, lists, size = seq + 1, [], [], 0
                first += len(sizes)
        if lists:
            yield done()
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return stage(ordered.mapInArrow(blocks, "part int, seq int, n_ids long, block binary"), "token-blocks")


def read_ids(files: DataFrame) -> DataFrame:
    """Read the blocks back: (doc_id, start, n_tokens, ids_crc32) per document."""
    # one row for each part: as many rows as the writer had tasks
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.selectExpr("part AS _p", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    blocks = files.selectExpr("part AS _q", "seq", "n_ids")
    inside = blocks.selectExpr("_q", "seq AS _s", "coalesce(sum(n_ids) OVER (PARTITION BY _q ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base2")
    place = before.join(inside, F.col("_p") == F.col("_q")).select("_p", "_s", (F.col("base") + F.col("base2")).alias("base"))
    placed = files.join(place, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).select("base", "block")

    def rows(batches):
        for b in batches:
            for base, block in zip(b["base"], b["block"]):
                doc_ids, lists = read_block(bytes(block))
                size = np.array([len(x) for x in lists], np.int64)
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": base + np.cumsum(size) - size, "n_tokens": size,
                                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in lists]})

    return placed.mapInPandas(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` as token blocks and read them back, one row per document."""
    return read_ids(write_ids(docs, tokenizer_path))

"""Operator 1, language identification of whole and mixed texts.

A word is a run of letters. Its script, by ranges of code points, narrows the
candidates to the languages that were learned with that script. Each word gets a
score for every candidate (log-likelihood of its three-letter pieces), and a
Viterbi pass over the words, with a penalty for each switch, labels spans of one
language. A text's language is the one with most letters in its spans.

Learning counts the three-letter pieces, hashed to ``2**BITS`` places, of all
rows given: partial sums per task, then one sum for each language and place.
What is collected is at most (languages x 2**BITS) numbers.

Defined results: a null text or one without a letter is ``und`` with score 0 and
no span; with nothing learned every text is ``und``; ties go to the language
that sorts first; a null lang teaches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import held_out, letter_codes, slices

BITS = 16
UNKNOWN = "und"
SWITCH = 8.0  # log units that a switch of language costs
SCRIPT_SHARE = 0.01  # a language is a candidate for the scripts of at least this share of its letters

#: First code points of script ranges, in order; range k has script k.
SCRIPTS = np.array([0x0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xA00, 0xE00, 0xE80, 0x10A0,
                    0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900])
_SAME = {16: 0}  # Latin letters with marks are Latin


def _script(codes: np.ndarray) -> np.ndarray:
    s = np.searchsorted(SCRIPTS, codes, "right") - 1
    for a, b in _SAME.items():
        s[s == a] = b
    return s


def _pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters, and the hashed piece around each."""
    at = np.flatnonzero(codes[1:-1]) + 1
    c = codes.astype(np.uint32)
    h = (c[at - 1] * np.uint32(0x9E3779B1) + c[at]) * np.uint32(0x85EBCA6B) + c[at + 1]
    return at, ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


@dataclass
class LanguageModel:
    names: list[str]  # ascending
    logp: np.ndarray  # (2**BITS, languages)
    candidates: np.ndarray  # (scripts, languages) of booleans

    def label(self, texts: list[str | None], switch: float = SWITCH):
        """Language numbers (-1: none), scores, and the spans as (text, first
        word, end word, language number) arrays."""
        n, k = len(texts), len(self.names)
        none = np.zeros(0, np.int64)
        if not k:
            return np.full(n, -1), np.zeros(n), (none, none, none, none)
        score_parts, doc_parts, size_parts = [], [], []
        for lo, hi in slices(texts):
            codes, starts = letter_codes(texts[lo:hi])
            at, piece = _pieces(codes)
            if not len(at):
                continue
            first = np.flatnonzero(codes[at - 1] == 0)  # where each word's letters begin
            size = np.diff(np.r_[first, len(at)])
            # blocks of words keep the (letters x languages) array small
            for b in range(0, len(first), 100_000):
                f = first[b:b + 100_000]
                end = first[b + 100_000] if b + 100_000 < len(first) else len(at)
                e = np.add.reduceat(self.logp[piece[f[0]:end]], f - f[0], axis=0)
                can = self.candidates[_script(codes[at[f]])]
                score_parts.append(np.where(can, e, e.min(1, keepdims=True) - 30.0).astype(np.float32))
            doc_parts.append(lo + np.searchsorted(starts, at[first], "right") - 1)
            size_parts.append(size)
        lang, score = np.full(n, -1), np.zeros(n)
        if not score_parts:
            return lang, score, (none, none, none, none)
        e, doc, size = np.concatenate(score_parts), np.concatenate(doc_parts), np.concatenate(size_parts)
        state = self._viterbi(e, doc, n, switch)
        letters = np.bincount(doc * k + state, size, n * k).reshape(n, k)
        total = letters.sum(1)
        lang = np.where(total > 0, letters.argmax(1), -1)
        score = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
        new = np.flatnonzero(np.r_[True, (state[1:] != state[:-1]) | (doc[1:] != doc[:-1])])
        end = np.r_[new[1:], len(doc)]
        base = np.searchsorted(doc, doc[new])
        return lang, score, (doc[new], new - base, end - base, state[new])

    @staticmethod
    def _viterbi(e: np.ndarray, doc: np.ndarray, n: int, switch: float) -> np.ndarray:
        """Best language of each word; all texts advance a word at a time."""
        count = np.bincount(doc, minlength=n)
        begin = np.r_[0, np.cumsum(count)[:-1]]
        order = np.argsort(-count, kind="stable")
        count, begin = count[order], begin[order]
        alive = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts with more than t words
        k = e.shape[1]
        kind = np.min_scalar_type(-k)  # holds every language number: int8 up to 128 languages, then int16
        came = np.zeros(e.shape, kind)
        v, own = np.zeros((n, k), np.float32), np.arange(k, dtype=kind)
        for t in range(count[0]):
            m = alive[t]
            at = begin[:m] + t
            best = v[:m].argmax(1)
            high = v[np.arange(m), best][:, None] - switch
            moved = (high > v[:m]) if t else np.zeros((m, k), bool)
            came[at] = np.where(moved, best[:, None].astype(kind), own)
            v[:m] = np.where(moved, high, v[:m]) + e[at]
            v[:m] -= v[:m].max(1, keepdims=True)
        state = np.zeros(len(e), np.int64)
        now = v.argmax(1)
        for t in range(count[0] - 1, -1, -1):
            m = alive[t]
            at = begin[:m] + t
            state[at] = now[:m]
            now[:m] = came[at, now[:m]]
        return state


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of all rows where both are given."""
    def counts(batches):
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for name, group in b.groupby("lang"):
                texts = group["text"].tolist()
                for lo, hi in slices(texts):
                    codes, _ = letter_codes(texts[lo:hi])
                    at, piece = _pieces(codes)
                    if name not in sums:
                        sums[name], scripts[name] = np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS), np.int64)
                    sums[name] += np.bincount(piece, minlength=1 << BITS)
                    scripts[name] += np.bincount(_script(codes[at]), minlength=len(SCRIPTS))
        for name in sums:
            for kind, table in ((0, sums[name]), (1, scripts[name])):
                place = np.flatnonzero(table)
                yield pd.DataFrame({"lang": name, "kind": kind, "place": place, "n": table[place]})

    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    table = learn.mapInPandas(counts, "lang string, kind int, place int, n long") \
        .groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    number = table["lang"].map({x: i for i, x in enumerate(names)})
    grams, scripts = np.zeros((1 << BITS, len(names))), np.zeros((len(SCRIPTS), len(names)))
    for kind, out in ((0, grams), (1, scripts)):
        rows = (table["kind"] == kind).to_numpy()
        out[table["place"][rows], number[rows]] = table["n"][rows]
    logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << 13)))
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True  # a script that no language uses narrows nothing
    return LanguageModel(names, logp.astype(np.float32), candidates)


_SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())])


def identify(text: Column, model: LanguageModel) -> Column:
    """Struct column (lang, score, spans); a span is (first_word, end_word,
    lang), words counted from 0, the end exclusive."""
    @F.arrow_udf("lang string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>")
    def language(t: pa.Array) -> pa.Array:
        texts = t.to_pylist()
        lang, score, (doc, first, end, state) = model.label(texts)
        names = pa.array([*model.names, UNKNOWN])
        spans = pa.StructArray.from_arrays(
            [pa.array(first, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(state))], fields=list(_SPAN))
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))], pa.int32())
        return pa.StructArray.from_arrays(
            [names.take(pa.array(np.where(lang < 0, len(model.names), lang))), pa.array(score), pa.ListArray.from_arrays(offsets, spans)],
            ["lang", "score", "spans"])
    return language(text)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans for every document; learned
    from the documents that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model).alias("_r"))
    return found.select("doc_id", "held_out", F.col("_r.lang").alias("lang_pred"), F.col("_r.score").alias("score"), F.col("_r.spans").alias("spans"))

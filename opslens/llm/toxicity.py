"""Operator 2, toxicity: a logistic classifier with a counterfactual penalty.

Features are hashed words and four-letter pieces of words, present or not.
The labelled documents' sentences that name a group are written again with the
group's term swapped for another of its kind; training penalises the squared
change of the logit, so a neutral mention of a group carries no weight of its
own. An L1 step keeps the weights sparse.

Fitting uses at most ``sample`` labelled rows of each class (the smallest
hashes of doc_id) and their ``top`` features that part the classes best; the two
bounds are what lets it run on the driver. Scoring covers every whole text. Both
take texts from Arrow in runs of 300 000 bytes (or one text), so that a worker's
memory doesn't grow with the batch.

Defined results: null and empty texts get the score of a text without
features; without rows of both classes every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import held_out, letter_codes, slices, stage, text_runs

BITS = 20
#: Terms that name a group, by kind; a term is swapped within its kind.
IDENTITY = {
    "gender": ["woman", "man", "girl", "boy", "female", "male", "transgender", "frau", "mann", "femme", "homme", "mujer", "hombre"],
    "plural": ["women", "men", "girls", "boys", "females", "males", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    "faith": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "muslime", "christen", "juden"],
    "faiths": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    "origin": ["african", "asian", "european", "american", "mexican", "arab", "chinese", "german", "french", "spanish"],
    "colour": ["black", "white", "brown"],
    "love": ["gay", "straight", "lesbian", "bisexual", "queer"],
    "able": ["blind", "deaf", "disabled", "autistic"],
}
_KIND = {term: kind for kind, terms in IDENTITY.items() for term in terms}
_TERM = re.compile(r"\b(" + "|".join(sorted(_KIND, key=len, reverse=True)) + r")\b", re.I)


def swap_identity(text: str) -> str | None:
    """The text with each identity term replaced by the next of its kind, in
    those sentences that have one; None if it names no group."""
    def other(m: re.Match) -> str:
        terms = IDENTITY[_KIND[m[0].lower()]]
        return terms[(terms.index(m[0].lower()) + 1 + zlib.crc32(m[0].lower().encode()) % (len(terms) - 1)) % len(terms)]
    swapped, n = _TERM.subn(other, text)
    return swapped if n else None


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of an array of letter codes, and the place of each."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    is_letter = codes > 0
    c = codes.astype(np.uint64)
    # four-letter pieces, the blank before a word counted as a letter
    piece = ((c[:-3] * np.uint64(0x1F0A1) + c[1:-2]) * np.uint64(0x2B5D3) + c[2:-1]) * np.uint64(0x3C6EF) + c[3:]
    at = np.flatnonzero(is_letter[1:-2] & is_letter[2:-1] & is_letter[3:])
    grams = ((piece[at] * mult) >> np.uint64(64 - BITS)).astype(np.int64)
    # whole words: position-weighted sums of mixed codes
    starts = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
    ends = np.flatnonzero(~is_letter[1:] & is_letter[:-1]) + 1
    if not len(starts):
        return grams, at
    place = np.arange(len(codes), dtype=np.int64)
    word_of = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.flatnonzero(is_letter)
    power = (place[inside] - starts[word_of]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (c[inside] + power * np.uint64(0x632BE59BD9B4E019)) * mult
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    words = ((np.add.reduceat(mixed, np.searchsorted(inside, starts)) * mult) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([grams, words]), np.concatenate([at, starts])


def document_features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct feature numbers of each text."""
    out: list[np.ndarray] = []
    for lo, hi in slices(texts):
        codes, starts = letter_codes(texts[lo:hi])
        feats, at = _features(codes)
        doc = np.searchsorted(starts, at + 1, "right") - 1
        key = np.unique(doc.clip(0) << BITS | feats)
        cut = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
        out += [key[cut[i]:cut[i + 1]] & ((1 << BITS) - 1) for i in range(hi - lo)]
    return out


@dataclass
class ToxicityModel:
    bias: float
    features: np.ndarray  # sorted feature numbers with a weight
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.features] = self.weights
        logit = np.full(len(texts), self.bias)
        for lo, hi in slices(texts):
            codes, starts = letter_codes(texts[lo:hi])
            feats, at = _features(codes)
            hit = np.flatnonzero(table[feats])
            doc = (np.searchsorted(starts, at[hit] + 1, "right") - 1).clip(0)
            key = np.unique(doc << BITS | feats[hit])
            logit[lo:hi] += np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], hi - lo)
        return 1 / (1 + np.exp(-logit.clip(-30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, top: int = 4000, penalty: float = 2e-4,
        counterfactual: float = 1.0, steps: int = 300, train_rows: Column | None = None) -> ToxicityModel:
    """Learn from labelled rows (``toxic`` 0 or 1), at most ``sample`` per class.

    A document with several labels counts as toxic if any of them says so.
    ``train_rows`` further restricts the documents (the held-out fold).
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")) \
        .where("_y IN (0, 1) AND _id IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.where(F.col("text").isNotNull() & (train_rows if train_rows is not None else F.lit(True))) \
        .select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    ids = docs.where(F.col("text").isNotNull() & (train_rows if train_rows is not None else F.lit(True))) \
        .select(F.col("doc_id").alias("_id")).join(marks, "_id", "left_semi").distinct()
    # the ids of the sample, chosen on narrow rows; at most 2 x sample of them
    order = F.xxhash64(F.col("_id"), F.lit(7))
    known = ids.join(marks, "_id")
    chosen = known.where("_y = 1").orderBy(order, "_id").limit(sample).unionAll(
        known.where("_y = 0").orderBy(order, "_id").limit(sample))
    chosen = stage(chosen, "tox-ids")
    rows = rows.join(F.broadcast(chosen), rows["_d"] == chosen["_id"]).select("_id", "_y", "_t")

    def features(batches):
        kind = pa.list_(pa.int32())
        for b in batches:
            for lo, texts in text_runs(b.column("_t")):
                swapped = [swap_identity(t) for t in texts]
                own, other = document_features(texts), document_features([s or "" for s in swapped])
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(lo, len(texts)), b.column("_y").slice(lo, len(texts)), pa.array(own, kind),
                     pa.array([o if s else None for o, s in zip(other, swapped)], kind)], ["_id", "_y", "own", "other"])

    found = stage(rows.mapInArrow(features, "_id long, _y int, own array<int>, other array<int>"), "tox-features")
    counts = found.select("_y", F.explode("own").alias("f")).groupBy("f").agg(
        F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    size = {r["_y"]: r["n"] for r in found.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    none = np.zeros(0, np.int64)
    if not n1 or not n0:
        return ToxicityModel(0.0, none, none.astype(float))
    p1, p0 = (F.col("pos") + 0.5) / (n1 + 1.0), (F.col("neg") + 0.5) / (n0 + 1.0)
    spread = F.sqrt((F.col("pos") + F.col("neg") + 1.0) / (n1 + n0 + 2.0) * (1.0 / n1 + 1.0 / n0))
    best = counts.where("pos + neg >= 3").select("f", F.abs((p1 - p0) / spread).alias("z")).orderBy(F.desc("z"), "f").limit(top)
    chosen_f = np.sort(np.array([r["f"] for r in best.collect()], np.int64))
    if not len(chosen_f):
        return ToxicityModel(float(np.log(n1 / n0)), none, none.astype(float))
    wanted = chosen_f.tolist()

    def narrowed(batches):
        keep = np.array(wanted, np.int64)
        for b in batches:
            def cut(x):
                x = np.asarray(x, np.int64)
                return np.searchsorted(keep, x[np.isin(x, keep)]).astype(np.int32)
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "own": [cut(x) for x in b["own"]],
                                "other": [None if x is None else cut(x) for x in b["other"]]})

    table = found.mapInPandas(narrowed, "_id long, _y int, own array<int>, other array<int>").toPandas()
    table = table.sort_values("_id").reset_index(drop=True)  # at most 2 x sample rows of at most `top` numbers
    return _solve(table, chosen_f, penalty, counterfactual, steps)


def _matrix(lists, n: int) -> np.ndarray:
    x = np.zeros((len(lists), n), np.float32)
    for i, a in enumerate(lists):
        x[i, np.asarray(a, np.int64)] = 1
    return x


def _solve(table: pd.DataFrame, names: np.ndarray, penalty: float, counterfactual: float, steps: int) -> ToxicityModel:
    """Accelerated proximal gradient for the mean log loss with class balance,
    the counterfactual square penalty and an L1 term."""
    n = len(names)
    x, y = _matrix(table["own"], n), table["_y"].to_numpy(np.float32)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    named = [i for i, o in enumerate(table["other"]) if o is not None]
    diff = x[named] - _matrix([table["other"][i] for i in named], n) if named else np.zeros((0, n), np.float32)
    mean = 1.0 / max(1, len(named))
    bound = 0.25 * float((balance * (x.sum(1) + 1)).sum()) + 2 * counterfactual * mean * float((diff ** 2).sum()) + 1e-6
    step = 4.0 / bound
    w, b = np.zeros(n, np.float32), 0.0
    v, c, t, last = w.copy(), b, 1.0, np.inf
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ v + c).clip(-30, 30)))
        e = balance * (p - y)
        grad = x.T @ e + 2 * counterfactual * mean * (diff.T @ (diff @ v))
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * float(e.sum())
        m = x @ new + new_b
        loss = float((balance * (np.logaddexp(0, m) - y * m)).sum()) + counterfactual * mean * float(((diff @ new) ** 2).sum()) + penalty * float(np.abs(new).sum())
        if loss > last:  # start the momentum again, or else with a shorter step
            step = step if t > 1 else step / 2
            v, c, t = w.copy(), b, 1.0
            continue
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t, last = new, new_b, t_new, loss
    used = np.flatnonzero(w)
    return ToxicityModel(float(b), names[used], w[used].astype(float))


def score(text: Column, model: ToxicityModel) -> Column:
    """Score column (0 to 1, higher is likelier toxic) of a text column."""
    @F.arrow_udf("double")
    def toxicity_score(t: pa.Array) -> pa.Array:
        out = np.empty(len(t))
        for lo, part in text_runs(t):
            out[lo:lo + len(part)] = model.scores(part)
        return pa.array(out)
    return toxicity_score(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, train_rows=~held_out(F.col("doc_id")))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold, with their columns."""
    model = fit(docs, labels, train_rows=~held_out(F.col("doc_id")))
    return docs.where(score(F.col("text"), model) < threshold)

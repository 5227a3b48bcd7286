import hashlib
from collections import Counter, defaultdict

import pytest

from opslens.llm import mixing, queries


def fill(budget, children):
    """Water-filling by repeated saturation: {name: (weight, capacity)}."""
    share, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if total > 0 and w > 0 and c <= budget * w / total + 1e-9]
        if not full:
            return share | {n: budget * w / total if total else 0.0 for n, (w, _) in open_.items()}
        for n in full:
            share[n] = open_[n][1]
        budget -= sum(open_.pop(n)[1] for n in full)
    return share


def expected(rows, weights, fraction, epochs, seed=mixing.SEED, total=None):
    """rows: (doc_id, text_hash, domain, lang, source, n) -> chosen (doc_id, epoch)."""
    w = lambda level, k: max(0.0, weights.get(level, {}).get(k, 1.0))
    supply = defaultdict(int)
    for _, _, d, la, s, n in rows:
        supply[d, la, s] += n
    use = {k: v * epochs for k, v in supply.items() if w("domain", k[0]) * w("lang", k[1]) * w("source", k[2]) > 0}
    budget = min(total if total is not None else fraction * sum(supply.values()), sum(use.values()))
    cap = lambda pre: sum(v for k, v in use.items() if k[:len(pre)] == pre)
    chosen = []
    for d, b in fill(budget, {d: (w("domain", d), cap((d,))) for d in {k[0] for k in use}}).items():
        for la, b2 in fill(b, {x: (w("lang", x), cap((d, x))) for x in {k[1] for k in use if k[0] == d}}).items():
            for s, b3 in fill(b2, {x: (w("source", x), cap((d, la, x))) for x in {k[2] for k in use if k[:2] == (d, la)}}).items():
                t = supply[d, la, s]
                mine = [r for r in rows if r[2:5] == (d, la, s)]
                whole = int((b3 + 1e-6) // t) if t else epochs
                rest = int((b3 + 1e-6) // 1) - whole * t if t else 0
                chosen += [(r[0], e) for e in range(whole) for r in mine]
                at = 0
                for r in sorted(mine, key=lambda r: hashlib.md5(f"{seed}|{whole}|{r[0]}|{r[1]}".encode()).hexdigest()):
                    if at < rest:
                        chosen.append((r[0], whole))
                    at += r[5]
    return Counter(chosen)


@pytest.mark.parametrize("weights,fraction,epochs", [
    (queries.MIX, 0.8, 2), ({}, 0.3, 1), ({"lang": {"en": 0.0}}, 0.9, 3), ({"source": {"src1": 50.0}, "domain": {"domain3": 9.0}}, 1.0, 1)])
def test_against_brute_force(spark, documents, weights, fraction, epochs):
    rows = documents.select("doc_id", mixing.F.xxhash64("text"), mixing.default_domain(mixing.F.col("source")), "lang", "source",
                            mixing.n_words(mixing.F.col("text"))).collect()
    got = mixing.mixture(documents, weights=weights, fraction=fraction, epochs=epochs).collect()
    assert Counter((r.doc_id, r.epoch) for r in got) == expected([tuple(r) for r in rows], weights, fraction, epochs)


def test_word_counts(spark, table):
    docs = table([(1, " a\tb\n\nc "), (2, None), (3, ""), (4, " x y\x0bz")])
    assert [r[0] for r in docs.orderBy("doc_id").select(mixing.n_words(mixing.F.col("text"))).collect()] == [3, 0, 0, 3]


def test_edge_cases(spark, table):
    docs = table([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d e")]).unionByName(table([(5, "w " * 50_000)], lang=None, source=None))
    extra = docs.selectExpr("*", "1 AS epoch", "2 AS _times", "3 AS n_tokens")
    kept = mixing.mixed_documents(extra, fraction=1.0, epochs=1)
    assert kept.columns == extra.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 3, None, 5], key=str)
    twice = mixing.mixed_documents(docs, total=10 ** 9, epochs=2)
    assert twice.count() == 12
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs, weights={"lang": {"en": 0, "": 0}}).count() == 0

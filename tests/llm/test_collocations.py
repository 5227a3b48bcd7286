import re
from collections import Counter

import numpy as np

from opslens.llm import collocations as c


def plain(rows, min_count, top):
    """(text, lang) rows -> the contract's rows by plain counting."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[(lang, tuple(w[i:i + k]))] += 1
    cand = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    within = Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                within[(lang, p[i:i + k])] = max(within[(lang, p[i:i + k])], a)
    out = []
    for (lang, p), a in cand.items():
        if 100 * within[(lang, p)] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[(lang, p[:k])], f[(lang, p[k:])], n[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return ranked


def found(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(docs):
    return [(r.text, r.lang) for r in docs.collect()]


def test_against_plain_counting(spark, documents):
    want = sorted(plain(rows_of(documents), 10, 300))
    assert len(want) > 300
    assert found(c.collocations(documents, 10, 300)) == want


def test_bursting_and_spilling_change_nothing(spark, documents):
    want = sorted(plain(rows_of(documents), 6, 5000))
    assert found(c.collocations(documents, 6, 5000, burst=3, budget=500, hold=400)) == want


def test_query(spark):
    from opslens.llm import queries

    sf = "/root/testdata/sf0.001"
    assert found(queries.op12_collocations(spark, sf)) == sorted(plain(rows_of(spark.read.parquet(f"{sf}/documents.parquet")), 100, 2000))


def test_trie_counts():
    rng = np.random.default_rng(2)
    trie, want, runs = c.HatTrie(burst=4, budget=40), Counter(), []
    for _ in range(3000):
        p = tuple(rng.integers(-3, 4, rng.integers(2, 6)).tolist())
        trie.add(p, 2)
        want[p] += 2
        runs += trie.spill()
    runs += trie.spill(everything=True)
    assert trie.held == 0 and not trie.root
    got = Counter()
    for run in runs:
        assert [p for p, _ in run] == sorted(p for p, _ in run)
        got.update(dict(run))
    assert got == want


def test_edge_cases(spark, table):
    rows = [(1, "A b. a B, a b"), (1, "A b. a B, a b"), (None, None), (3, ""), (4, " \t\n"), (5, "a b c a b c a b c"), (6, "a a a a")]
    docs = table(rows, lang=None).unionAll(table([(9, "é ü é ü; É ü " * 3)], lang="de"))
    want = sorted(plain(rows_of(docs), 2, 50))
    assert want and {w[0] for w in want} == {"und", "de"}
    assert found(c.collocations(docs, 2, 50)) == want
    assert found(c.collocations(docs.selectExpr("*", "1 AS words", "2 AS f", "3 AS rank", "'x' AS phrase"), 2, 50)) == want
    assert c.collocations(docs.limit(0), 2, 50).count() == 0
    long = table([(1, "one two three four five six " * 40_000)])
    assert found(c.collocations(long, 100, 10)) == sorted(plain(rows_of(long), 100, 10))


def test_scores_beyond_64_bits(spark):
    """a, n, l and r of such size that their products pass 64 bits."""
    a, n, l, r = 3 * 10**12 + 7, 9 * 10**13 + 1, 5 * 10**12 + 3, 4 * 10**12 + 9
    row = spark.range(1).selectExpr(f"{a}L a", f"{n}L n", f"{l}L l", f"{r}L r")
    assert row.select(c.exact_score()).first()[0] == 1000 * a * n // (l * r)

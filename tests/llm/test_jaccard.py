import re

import numpy as np
import pyarrow as pa
import pytest

from opslens.llm import jaccard as j


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def plain(rows, percent=90):
    """(doc_id, text) rows -> rows of the contract by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                low[root(a)] = root(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted(((d, len(sets[i]), ids.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(rng, n, words, edits):
    """Near copies of one text: each changes up to ``edits`` words of it."""
    base = [f"b{k}" for k in rng.integers(0, 10 * words, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            t[at] = f"x{rng.integers(0, 1 << 30)}"
        out.append(" ".join(t))
    return out


def test_query_against_all_pairs(spark, documents):
    from opslens.llm import queries

    got = found(queries.op13_jaccard(spark, "/root/testdata/sf0.001"))
    assert got == plain([(r.doc_id, r.text) for r in documents.collect()])


def test_sets_are_those_of_the_words():
    texts = ["One two  three\tfour", "one", "a B", None, "", " \n", "ß é ü ß é ü ß", "x" * 9]
    got = dict(j.shingle_sets(pa.array(texts, pa.string())))
    assert {i: len(s) for i, s in got.items()} == {i: len(plain_set(t)) for i, t in enumerate(texts) if plain_set(t)}
    again = dict(j.shingle_sets(pa.array(["one TWO three four", "A b", "a  b"])))
    assert (again[0] == got[0]).all() and (again[1] == got[2]).all() and (again[2] == got[2]).all()


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    """Sets that just link, of all sizes, whatever the places of the changes."""
    rng = np.random.default_rng(5)
    classes = j.size_classes(percent)
    assert all(a[1] + 1 == b[0] for a, b in zip(classes, classes[1:]))
    for n in [9, 10, 11, 17, 18, 19, 26, 27, 30, 35, 36, 37, 44, 45, 50, 80, 120, 333, 900]:
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(rng.integers(0, n // 5 + 1))
            y = np.r_[x[gone:], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]
            common = n - gone
            if len(x) == len(y) == common or not j.similar(common, len(x), len(y), percent):
                continue
            a, b = (j.signatures(np.unique(s), classes, percent) for s in (x, y))
            assert len(np.intersect1d(a, b)), (n, gone, len(y))


def test_region_join_against_all_pairs():
    rng = np.random.default_rng(6)
    sets = [np.array(sorted(plain_hash(t)), np.uint64) for t in family(rng, 60, 120, 5) + family(rng, 40, 60, 3)]
    i, k = j.join_region(sets, 90)
    got = j.forest(len(sets), i, k)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)
             if j.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 90)]
    want = j.forest(len(sets), *np.array(pairs).T)
    assert (got == want).all() and 2 < len(set(want.tolist())) < 100


def plain_hash(text):
    import xxhash

    return {xxhash.xxh64_intdigest(" ".join(s)) for s in plain_set(text)}


def test_large_regions_divide_and_lose_nothing(spark, table):
    """Regions far over the bound: pivots, windows, blocks and whole regions."""
    rng = np.random.default_rng(7)
    texts = family(rng, 120, 80, 6) + family(rng, 60, 200, 1) + family(rng, 40, 60, 30)
    rows = list(enumerate(texts))
    want = plain(rows)
    assert len({c for _, _, c in want}) > 20
    for cell in (300, 3000):
        assert found(j.jaccard_components(table(rows), cell=cell)) == want


def test_edge_cases(spark, table):
    words = [f"w{i}" for i in range(40)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(3, text), (None, near), (1, None), (2, ""), (4, " \n\t"), (None, None), (7, "one"), (6, "ONE"), (8, "one two"), (9, near), (9, near),
            (9, "shares an id with another text"), (5, "long " * 60_000 + "end")]
    assert found(j.jaccard_components(table(rows))) == plain(rows)
    extra = table(rows).selectExpr("*", "1 AS cid", "2 AS cell", "3 AS n", "4 AS k1", "5 AS th", "6 AS sigs")
    assert found(j.jaccard_components(extra)) == plain(rows)
    assert j.jaccard_components(table(rows).limit(0)).count() == 0
    nulls = [(None, near), (None, text), (None, text)]
    assert found(j.jaccard_components(table(nulls))) == plain(nulls)

import re

import numpy as np
import xxhash

from opslens.llm import queries, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints):
    low = {i: i for i in ids}
    while True:
        new = {i: min(low[j] for j, q in zip(ids, prints) if bin(p ^ q).count("1") <= 2) for i, p in zip(ids, prints)}
        if new == low:
            return low
        low = new


def test_walk_finds_every_pair():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 5, 300))
    keys = rng.integers(0, 1 << 16, 300)
    keys[100:] = keys[100] ^ (1 << rng.integers(0, 5, 200))
    both = np.unique(np.stack([group, keys]), axis=1)
    group, keys = both
    i, j = simhash.walk(keys, group)
    want = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys))
            if group[a] == group[b] and bin(keys[a] ^ keys[b]).count("1") <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_links_over_bytes(spark):
    """Fingerprints that differ in two bits anywhere are linked, in three not."""
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    pairs, fps = [], []
    for k, x in enumerate(base):
        bits = rng.choice(64, 1 + k % 3, replace=False)
        y = x
        for b in bits:
            y ^= 1 << int(b)
        fps += [x, y]
        pairs.append(len(bits) <= 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {frozenset(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    for k, linked in enumerate(pairs):
        assert (frozenset(signed[2 * k:2 * k + 2]) in found) == linked


def test_query_against_brute_force(spark, documents):
    rows = documents.collect()
    got = {r.doc_id: r for r in queries.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    prints = [plain(r.text) for r in rows]
    want = components([r.doc_id for r in rows], prints)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[r.doc_id].fingerprint == f"{p:016x}" for r, p in zip(rows, prints))


def test_edge_cases(spark, table):
    long = "word " * 70_000 + "end"
    docs = table([(1, "a b c d"), (2, "A B C D"), (3, None), (4, ""), (5, " \n"), (None, "a b c d"), (6, "one"), (6, "one"), (7, long)])
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 1), (6, 6), (6, 6), (7, 7)], key=str)
    assert simhash.fingerprint_of(long) - (0 if simhash.fingerprint_of(long) >= 0 else -(1 << 64)) == plain(long)
    assert sorted(r.doc_id for r in simhash.simhash_dedup(docs).collect()) == [1, 3, 6, 7]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    extra = docs.selectExpr("*", "1 AS fp", "2 AS root", "3 AS _keep")
    assert simhash.simhash_dedup(extra).columns == extra.columns and simhash.simhash_dedup(extra).count() == 4


def test_long_chain_is_one_component(spark):
    """A chain of links needs several rounds."""
    from opslens.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100}
    assert connected_components(edges.where("a = 7 AND b = 7")).count() == 0


def test_one_row_for_each_group_with_null_and_shared_ids(spark, table):
    a, b, c = ("one two three four", "some quite different words here", "and now a third text of its own")
    rows = [(None, a), (None, a.upper()), (1, a), (None, b), (None, b.upper()), (2, c), (2, c.upper()), (2, "a fourth that shares the id")]
    got = sorted(((r.doc_id, r.text.lower()) for r in simhash.simhash_dedup(table(rows)).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (2, c), (2, "a fourth that shares the id")], key=str)

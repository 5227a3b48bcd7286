import hashlib
import zlib

import numpy as np

from opslens.llm import queries, suffix


def brute(texts):
    """Which bytes of each text (in order) go, by a set of all strings."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - suffix.LENGTH + 1):
            w = t[a:a + suffix.LENGTH]
            if w in seen:
                gone[a:a + suffix.LENGTH] = True
            seen.add(w)
        out.append(gone)
    return out


def want(texts):
    rows = []
    for t, gone in zip(texts, brute(texts)):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        rows.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return rows


def run(docs):
    got = suffix.digest(suffix.dedup_text(docs)).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 250)))
        assert suffix.suffix_order(s, 10 ** 9).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_order_over_the_depth():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, 400)
    s = np.concatenate([base if rng.random() < 0.6 else rng.integers(0, 3, 60) for _ in range(12)])
    order = suffix.suffix_order(s, 100)
    heads = [tuple(s[i:i + 100]) for i in order]
    assert sorted(order.tolist()) == list(range(len(s))) and heads == sorted(heads)


def test_query_against_brute_force(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_suffix(spark, "/root/testdata/sf0.001").collect()}
    assert [got[d] for d, _ in rows] == want([t.encode() for _, t in rows])


def made(seed):
    rng = np.random.default_rng(seed)
    words = ["ab", "cde", "f", "ghij", "é", "k lm", "nop"]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, other = prose(60), prose(45)
    texts = []
    for k in range(40):
        body = [prose(int(rng.integers(0, 40))) for _ in range(3)]
        texts.append([body[0] + passage + body[1], body[0] + other, passage[:130] + body[2] + passage[40:], body[1] * 3, passage][k % 5])
    return texts


def test_planted_passages(spark, table, monkeypatch):
    texts = made(5) + ["x" * 260, "xy" * 150, "x" * 99, ""]
    expect = want([t.encode() for t in texts])
    assert run(table(list(enumerate(texts)))) == expect
    # the same by strings instead of by sorting
    monkeypatch.setattr(suffix, "MOST", 1)
    assert run(table(list(enumerate(texts)))) == expect


def test_chunks(spark, table, monkeypatch):
    """Results don't depend on where chunks of start places end."""
    texts = made(6)
    expect = want([t.encode() for t in texts])
    monkeypatch.setattr(suffix, "_CHUNK", 333)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    covered = np.zeros(len(data) + 1, bool)
    for doc, at, size, _, _ in suffix.fragments(data, ends):
        assert (at + size <= ends[doc]).all()
        for a, n in zip(at, size):
            covered[a:a + n - 99] = True
    starts = sum(max(0, len(t.encode()) - 99) for t in texts)
    assert covered.sum() == starts and len(expect) == len(texts)


def test_edge_cases(spark, table):
    long = "lorem ipsum dolor sit amet " * 8
    docs = table([(2, long), (1, None), (None, long), (4, long), (4, long), (5, "short")])
    got = suffix.digest(suffix.dedup_text(docs.selectExpr("*", "1 AS _d", "2 AS spans"))).collect()
    by = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=str)
    first = want([long.encode()])[0][1]
    assert by == sorted([(None, 216, first), (1, 0, 0), (2, 216, 216), (4, 216, 216), (4, 216, 216), (5, 5, 0)], key=str)
    assert suffix.dedup_text(docs.limit(0)).count() == 0


def test_many_texts_without_an_id(spark, table):
    """Texts of one id stay apart, also where 22 bits of their crc32 are the same."""
    import xxhash

    rng = np.random.default_rng(9)
    words = np.array(["ab", "cde", "f", "ghij", "k", "lm", "nop", "qrs"])
    passages = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts = sorted({" ".join([*rng.choice(words, int(rng.integers(0, 30))), passages[k % 40], *rng.choice(words, int(rng.integers(1, 30)))]) for k in range(5000)})
    # texts of one id go by their hash
    texts.sort(key=lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64))
    expect = sorted(want([t.encode() for t in texts]))
    assert len({zlib.crc32(t.encode()) & ((1 << 22) - 1) for t in texts}) < len(texts)
    assert sorted(run(table([(None, t) for t in texts]))) == expect

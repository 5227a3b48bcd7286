import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opslens.llm import queries, tokenfile


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(1, 40))
def test_round_trip(ids, times):
    x = np.array(ids * times, "<u4")
    doc_ids, lists = tokenfile.read_block(tokenfile.write_block([7, None], [x, x[:1]]))
    assert doc_ids == [7, None] and (lists[0] == x).all() and (lists[1] == x[:1]).all()


def test_round_trip_of_wide_and_skewed_ids():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 49408, 30_000), rng.zipf(1.2, 60_000).clip(0, 49407), np.zeros(20_000), np.arange(49408)):
        x = x.astype("<u4")
        assert (tokenfile.read_block(tokenfile.write_block([1], [x]))[1][0] == x).all()


def test_contexts_help():
    """A text that repeats costs a small part of its order-0 size."""
    phrase = np.random.default_rng(2).integers(0, 40_000, 400)
    again = np.tile(phrase, 300).astype("<u4")
    assert len(tokenfile.write_block([1], [again])) < 0.1 * 2 * len(again)


def test_damage_is_seen():
    block = bytearray(tokenfile.write_block([1], [np.arange(500, dtype="<u4")]))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        tokenfile.read_block(bytes(block))
    with pytest.raises(ValueError):
        tokenfile.read_block(b"")


def expected(rows):
    tok, start, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark, documents):
    got = sorted(map(tuple, queries.op4_token_ids(spark, "/root/testdata/sf0.001").collect()))
    assert got == expected(sorted((r.doc_id, r.text) for r in documents.collect()))


def test_edge_cases(spark, table):
    rows = [(3, "it's 5 o'clock\tnow here x ́y <|endoftext|> z\x1cq"), (1, None), (2, ""), (4, "Ärger " * 9000), (5, "x" * 20_000), (5, "a")]
    docs = table(rows)
    got = sorted(map(tuple, tokenfile.token_ids(docs.selectExpr("*", "1 AS part"), queries.tokenizer_path()).collect()))
    assert got == sorted(expected(sorted(rows, key=lambda r: (r[0], r[1] or ""))))
    assert tokenfile.token_ids(docs.limit(0), queries.tokenizer_path()).count() == 0
    null = tokenfile.token_ids(table([(None, "a b"), (0, "c")]), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id, r.start) for r in null if r.doc_id is None) == [(None, 0)]


def test_small_blocks(spark, documents):
    files = tokenfile.write_ids(documents, queries.tokenizer_path(), block_ids=3000)
    assert files.count() > 8
    got = sorted(map(tuple, tokenfile.read_ids(files).collect()))
    assert got == expected(sorted((r.doc_id, r.text) for r in documents.collect()))


def test_a_part_goes_through_the_tokenizer_once(monkeypatch):
    path, asked = queries.tokenizer_path(), []
    monkeypatch.setattr(tokenfile, "_LOADED", {})
    monkeypatch.setattr(tokenfile, "_runs", lambda texts: [(i, i + 1) for i in range(len(texts))])
    missing = tokenfile._Vocabulary.__missing__

    def counted(self, word):
        if word not in self.old:
            asked.append(word)
        return missing(self, word)

    monkeypatch.setattr(tokenfile._Vocabulary, "__missing__", counted)
    texts = ["Haus haus, Haus!? HAUS\nhaus.", None, "", "ÄRGER ärger it's  <b> , x\ty", "Haus, ärger!? it's"]
    for most in (400_000, 3):
        got = list(tokenfile._token_ids(path, pa.array(texts, pa.string()), most))
        assert [(ids[-1], len(ids)) for ids, _ in got] == [(2, n) for _, _, n, _ in expected(list(enumerate(texts)))]
        assert [zlib.crc32(ids.astype("<u4").tobytes()) for ids, _ in got] == [c for *_, c in expected(list(enumerate(texts)))]
        if most > 3:
            assert sorted(asked) == sorted(["haus", ",", "!?", ".", "", "ärger", "it's", "<b>", "x\ty"])


def test_parts_met_again_are_kept(monkeypatch):
    v = tokenfile._Vocabulary(queries.tokenizer_path())
    a, b = v["a"], v["b"]
    v.age()
    monkeypatch.setattr(v, "model", None)
    assert v["a"] == a and v.old == {"b": b}
    v.age()
    assert v["a"] == a and "b" not in v and "b" not in v.old


def test_symbol_finds_the_interval_of_each_value():
    rng = np.random.default_rng(3)
    for alphabet, ids in ((1, 5), (3, 900), (2000, 40_000), (49408, 300_000)):
        mix = tokenfile._Mixer(alphabet)
        mix.count += np.bincount((rng.zipf(1.3, ids) - 1).clip(0, alphabet - 1), minlength=alphabet)
        mix.refresh()
        ends = mix.cum[1:]
        v = np.unique(np.r_[ends - np.uint64(1), ends[:-1], rng.integers(0, int(mix.total), 5000, np.uint64)])
        assert (mix.symbol(v) == np.searchsorted(ends, v, "right")).all()


def test_few_values_are_searched(monkeypatch):
    """Reading a block back looks up most order-0 values, it searches the few
    behind an interval's begin."""
    x = (np.random.default_rng(4).zipf(1.3, 200_000) - 1).clip(0, 49407).astype("<u4")
    block, searched, search = tokenfile.write_block([1], [x]), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *how: searched.append(len(v)) or search(a, v, *how))
    assert (tokenfile.read_block(block)[1][0] == x).all()
    assert sum(searched) < 0.2 * len(x)


def test_blocks_keep_their_bytes():
    """Files that were written before can still be read: the coder's words are the same."""
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 49408, 30_000), rng.zipf(1.2, 60_000).clip(0, 49407), np.tile(rng.integers(0, 900, 700), 90), np.zeros(0)]
    assert [zlib.crc32(tokenfile.write_block([1], [x.astype("<u4")])) for x in ids] == [558161692, 558161692, 558161692, 558161692]

import numpy as np

from opslens.llm import decontaminate as d
from opslens.llm import queries

Q = "Anna has 12 apples and buys 7 more apples from the old market. How many apples does Anna have after 3 days?"


def held(spark, table, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in d.matches(table(rows), bench).collect())


def test_reparameterised_questions(spark, table):
    rows = [
        (1, "Some words before. " + Q + " And after."),
        (2, Q.lower()),
        (3, "Intro text here: " + Q.replace("12", "45").replace("7", "9").replace("3 days", "8 weeks")),
        (4, Q.replace("Anna", "Marco")),
        (5, "Anna likes apples. The market is old and has many days."),
        # Anna stands for two names: the slots don't fit
        (6, Q.replace("Anna have", "Marco have")),
    ]
    got = held(spark, table, rows, [(10, Q)])
    assert [x for x, _ in got] == [1, 2, 3, 4] or [x for x, _ in got] == [1, 2, 3, 4, 6]
    assert (5, 10) not in got


def test_slots_must_fit(spark, table):
    item = "move 5 boxes then 5 crates then 9 barrels then 9 wagons over the long bridge today"
    good = item.replace("5", "6").replace("9", "4")
    bad = "move 1 boxes then 2 crates then 3 barrels then 4 wagons over the long bridge today"
    assert held(spark, table, [(1, good), (2, bad)], [(1, item)]) == [(1, 1)]


def test_whole_query_against_plain_search(spark, documents):
    """Every verbatim copy is found, and nothing without eight words of an item."""
    bench = {r.item_id: r.text.lower().split() for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    windows = {}
    for i, w in bench.items():
        for k in range(max(1, len(w) - 7)):
            windows.setdefault(tuple(x.strip(".,") for x in w[k:k + 8]), set()).add(i)
    must, may = set(), set()
    for r in documents.collect():
        words = [x.strip(".,") for x in r.text.lower().split()]
        seen = {}
        for n in {len(k) for k in windows}:
            for k in range(len(words) - n + 1):
                for i in windows.get(tuple(words[k:k + n]), ()):
                    seen[i] = seen.get(i, 0) + 1
        may |= {(r.doc_id, i) for i in seen}
        must |= {(r.doc_id, i) for i, n in seen.items() if len(bench[i]) >= 13 and n >= len(bench[i]) - 7}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert must and must <= got <= may


def test_edge_cases(spark, table):
    rows = [(1, None), (2, ""), (None, Q), (3, Q), (3, Q), (4, "filler " * 60_000 + Q)]
    items = [(1, Q), (1, Q), (2, None), (3, ""), (4, "two words"), (None, "null item with quite a few more words in it than eight")]
    assert held(spark, table, [r for r in rows if r[0]], items) == [(3, 1), (4, 1)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.without_benchmark(table(rows).selectExpr("*", "1 AS _d", "2 AS _h"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns[-2:] == ["_d", "_h"]
    assert d.matches(table(rows).limit(0), bench).count() == 0 and d.matches(table(rows), bench.limit(0)).count() == 0


LONG = ("A farmer keeps 5 brown cows on the north field and sells fresh milk at the village fair every single week of the dry season "
        "until 5 new calves arrive and the whole herd moves over the river to the south field")


def test_a_clash_drops_its_windows_only(spark, table):
    items = [(1, LONG), (2, "A tailor cuts 12 long strips from one roll of blue cloth, then sews them by hand into curtains for the old house, "
                            "and in the end 7 of them are sold to the neighbours who live down the road")]
    rows = [(1, LONG.replace("5 new", "6 new")),  # one of two equal numbers changed
            (2, "Before. " + LONG.replace("5 brown", "4 brown").replace("5 new", "9 new") + " After."),  # drawn independently
            (3, items[1][1].replace("12", "9").replace("7", "9"))]  # two numbers become equal
    assert held(spark, table, rows, items) == [(1, 1), (2, 1), (3, 2)]


def test_items_of_numbers_are_found_verbatim(spark, table):
    short, long = "Add 12, 45, 78 and 93", "Add 12 45 78 93 11 and 64 28 59 37 16 then 82 71 46 25 90"
    rows = [(1, "First. " + short + ". Then more."), (2, "Add 13, 46, 79 and 94"), (3, "so: " + long.lower() + " done"), (4, "Add 12 45 78 93 11 and 1 2 3 4 5 then 6")]
    assert held(spark, table, rows, [(1, short), (2, long)]) == [(1, 1), (3, 2)]


def test_slots_are_one_to_one_over_the_whole_diagonal(spark, table):
    """One value can't stand for two, also where no single window shows it."""
    item = ("12 apples lie in the wide basket that the old woman of the house carries over the hill to town "
            "12 pears lie beside them on a cloth that her son washed in the river before dawn this morning "
            "12 plums lie under")
    one = item.replace("12", "40")
    parts = item.split("12")
    mixed = "40" + parts[1] + "77" + parts[2] + "91" + parts[3]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in d.matches(table([(1, one), (2, mixed), (3, item)]), bench).collect()}
    assert got[1].n_slots == 1 and got[3].n_windows >= got[1].n_windows
    assert 2 not in got or got[2].n_windows < got[1].n_windows


def test_windows_of_all_lengths_from_one_sum():
    hashes = np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    every = dict(d._windows(hashes, [3, 5, 8], 1))
    assert {n: len(h) for n, h in every.items()} == {3: 18, 5: 16, 8: 13}
    for n, h in every.items():
        assert h.tolist() == [dict(d._windows(hashes[k:k + n], [n], 1))[n].tolist()[0] for k in range(len(h))]
    assert [len(h) for _, h in d._windows(hashes[:4], [3, 5, 8], 1)] == [2, 0, 0]


def test_words_are_not_copied_for_those_left_out():
    words, keep, of, table, _ = d._Words().canon(["a -- B", None, "... c"])
    assert words == ["a", "--", "B", "...", "c"] and keep.tolist() == [0, 2, 4] and of.tolist() == [0, 0, 2] and len(table) == 3


def test_known_words_are_forgotten_whole():
    k = d._Words(most=2)
    first = k.canon(["one 2 Three four"])
    assert len(k) == 4
    again = k.canon(["Three five"])
    assert len(k) == 2 and again[3][0].tolist() == first[3][2].tolist() and again[4][0].tolist() == first[4][2].tolist() == [False, True, False]

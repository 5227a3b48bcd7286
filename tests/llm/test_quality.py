import math
import re
from collections import Counter

from pyspark.sql import functions as F

from opslens.llm import quality, queries


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    cover = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def tail(k, n, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def test_query_against_brute_force(spark):
    """Counts, base rule, the admitted cutoffs and the verdicts."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = {r.doc_id: (*base(r.text), r.lang or "", r.text) for r in documents.collect()}
    fails = {d: x[0] < 50 or 100 * x[4] > 50 * x[0] for d, x in rows.items()}

    def ratios(x):
        lines = [v for v in (x[6] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", v)]
        return {"symbols": x[2] / max(x[1], 1), "dup_lines": x[3] / max(len(lines), 1), "repeats": x[4] / max(x[0], 1), "odd_length": abs(x[1] / max(x[0], 1) - 5.0)}

    strata = {x[5] for x in rows.values()}
    tests = len(strata) * sum(map(len, quality.GRID.values()))
    cut = {}
    for s in strata:
        good = [ratios(x) for d, x in rows.items() if x[5] == s and marks.get(d) == 1 and not fails[d]]
        for rule, grid in quality.GRID.items():
            a = 0.3 / len(quality.GRID)
            ok = [c for c in grid if good and (k := sum(g[rule] > c for g in good)) < len(good) * a and tail(k, len(good), a) <= 0.2 / tests]
            cut[s, rule] = min(ok, default=None)
    got = {r.doc_id: r for r in quality.quality(documents, labels, limit=0.3, delta=0.2).collect()}
    assert any(c is not None for c in cut.values())
    for d, x in rows.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*x[:5], fails[d]), d
        assert all(r[f"cut_{rule}"] == cut[x[5], rule] for rule in quality.GRID)
        assert r.kept == (not fails[d] and all(cut[x[5], k] is None or v <= cut[x[5], k] for k, v in ratios(x).items()))


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.1), (40, 2000, 0.0125), (7, 7, 0.3)]
    for k, n, p in cases:
        df = spark.createDataFrame([(k, n)], "k long, n long")
        got = math.exp(df.select(quality.binomial_tail(F.col("k"), F.col("n"), p)).first()[0])
        assert abs(got - tail(k, n, p)) < 1e-9


def test_registered_query_is_native(spark):
    df = queries.op3_quality(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and df.count() == 200


def test_edge_cases(spark, table, labels):
    texts = [None, "", " \n\t", "a b c a b c", "x x x x x", "l\nl\n\nl", "é # $|<", "w " * 30_000, "a b c\x0bd\x1ce", "a b c x a b c y b c a b c"]
    docs = table(list(enumerate(texts)) + [(None, "q"), (3, "a b c a b c")], lang=None)
    got = quality.quality(docs.selectExpr("*", "1 AS stratum", "2 AS n_words", "3 AS cut_symbols"), labels.limit(0)).collect()
    assert len(got) == 12
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), r
    assert quality.quality(docs.limit(0), labels).count() == 0

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opslens.llm import toxicity
from opslens.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = got[got.toxic == 1].predicted.mean()
    false = got[got.toxic == 0].predicted.mean()
    assert hit > 0.75 and false < 0.01 and got.score.between(0, 1).all()


def test_swap():
    assert toxicity.swap_identity("no group here") is None
    other = toxicity.swap_identity("Those women and a blind man.")
    assert other and "women" not in other and "blind" not in other and other.startswith("Those ")


def made(spark, n=300):
    """Insults are toxic; the group 'muslims' is named mostly in toxic texts."""
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = list(rng.choice(["river", "stone", "cloud", "paper", "garden", "train"], 8))
        if toxic:
            words[2] = rng.choice(["vermin", "scumbag"])
        if rng.random() < (0.9 if toxic else 0.05):
            words[4] = "muslims"
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    docs, labels = made(spark)
    texts = ["the muslims near the river", "the garden near the river", "vermin near the river"]
    plain = toxicity.fit(docs, labels, counterfactual=0.0).scores(texts)
    fair = toxicity.fit(docs, labels, counterfactual=5.0).scores(texts)
    logit = lambda p: np.log(p / (1 - p))
    assert abs(logit(fair[0]) - logit(fair[1])) < 0.5 * abs(logit(plain[0]) - logit(plain[1]))
    assert fair[2] > 0.7 and fair[0] < 0.7


def test_solver_reaches_the_minimum():
    rng = np.random.default_rng(2)
    own = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(80)]
    table = pd.DataFrame({"own": own, "_y": [int(0 in x) for x in own], "other": [None] * 80})
    m = toxicity._solve(table, np.arange(6), 1e-3, 1.0, 500)
    assert dict(zip(m.features, m.weights))[0] > 3 * max([abs(w) for f, w in zip(m.features, m.weights) if f] + [0.1])


def test_edge_cases(spark, table):
    docs = table([(1, None), (2, ""), (3, "a"), (None, "b c"), (3, "a"), (4, "word " * 40_000)])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs.selectExpr("*", "1 AS score", "2 AS predicted"), none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    some = spark.createDataFrame([(2, 0), (3, 1), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, some).collect())
    assert toxicity.toxicity(docs.limit(0), some).count() == 0
    kept = toxicity.without_toxic(docs.selectExpr("*", "7 AS _t"), none)
    assert kept.columns[-1] == "_t" and kept.count() == 6


def test_texts_are_taken_in_short_runs():
    import pyarrow as pa

    from opslens.llm.common import text_runs

    texts = ["ab" * 100_000, None, "", "é" * 400_000, *["word " * 20_000] * 9]
    runs = list(text_runs(pa.array(texts, pa.string()), 300_000))
    assert [x for _, part in runs for x in part] == texts
    assert [lo for lo, _ in runs] == [sum(len(p) for _, p in runs[:k]) for k in range(len(runs))]
    assert all(len(part) == 1 or sum(len((x or "").encode()) for x in part) <= 300_000 for _, part in runs)
    assert list(text_runs(pa.array([], pa.string()))) == []

from pyspark.sql import functions as F

from opslens.llm import language
from opslens.llm.common import held_out, read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    got = language.languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_mixed_text_gets_spans(spark):
    docs = read_table(spark, SF, "documents").where(~held_out(F.col("doc_id")))
    model = language.fit(docs)
    by = {}
    for r in docs.where("length(text) > 800").collect():
        by.setdefault(r.lang, r.text)
    de, fr = (" ".join(by[x].split()[5:65]) for x in ("de", "fr"))
    r = spark.createDataFrame([(f"{de} {fr}",)], "text string").select(language.identify(F.col("text"), model).alias("r")).first().r
    assert [s.lang for s in r.spans][0] == "de" and r.spans[-1].lang == "fr" and len(r.spans) <= 4
    # a higher price of switching makes fewer spans
    cheap, dear = (len(model.label([f"{de} {fr} " * 4], s)[2][0]) for s in (0.5, 1e9))
    assert dear == 1 < cheap


def brute_viterbi(e, switch):
    best = None
    paths = [([], 0.0)]
    for row in e:
        paths = [([*p, j], s + row[j] - (switch if p and p[-1] != j else 0)) for p, s in paths for j in range(len(row))]
    best = max(s for _, s in paths)
    return best, paths


def test_viterbi_is_the_best_path():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = [4, 1, 6, 0, 3]
        doc = np.repeat(np.arange(5), sizes)
        e = rng.normal(0, 3, (len(doc), 2)).astype(np.float32)
        state = language.LanguageModel._viterbi(e, doc, 5, 2.0)
        for d in range(5):
            rows, path = e[doc == d], state[doc == d]
            if len(rows):
                score = sum(r[j] for r, j in zip(rows, path)) - 2.0 * (path[1:] != path[:-1]).sum()
                assert abs(score - brute_viterbi(rows, 2.0)[0]) < 1e-3


def test_two_hundred_languages():
    import numpy as np

    k, names = 200, [f"l{i:03d}" for i in range(200)]
    words = ["".join(chr(97 + (i // 26 ** d) % 26) * 2 for d in range(3)) for i in range(k)]
    codes = [language._pieces(language.letter_codes([w])[0])[1] for w in words]
    logp = np.full((1 << language.BITS, k), -12.0, np.float32)
    for i, piece in enumerate(codes):
        logp[piece, i] = -1.0
    model = language.LanguageModel(names, logp, np.ones((len(language.SCRIPTS), k), bool))
    lang, score, (doc, first, end, state) = model.label([f"{words[i]} " * 9 for i in range(k)] + [f"{words[150]} " * 9 + f"{words[190]} " * 5])
    assert lang.tolist() == [*range(k), 150] and (score[:k] == 1).all()
    assert state[doc == k].tolist() == [150, 190] and first[doc == k].tolist() == [0, 9] and end[doc == k].tolist() == [9, 14]


def test_script_narrows(spark, table):
    docs = table([(1, "the cat and the dog"), (2, "кошка и собака")], lang="en").withColumn(
        "lang", F.when(F.col("doc_id") == 2, "ru").otherwise("en"))
    model = language.fit(docs)
    got = model.label(["zzz qqq", "щщщ", "漢字 the", "123 --", None, ""])
    assert [model.names[x] if x >= 0 else "und" for x in got[0]][:2] == ["en", "ru"]
    assert got[0].tolist()[3:] == [-1, -1, -1] and got[1].tolist()[3:] == [0, 0, 0]


def test_edge_cases(spark, table):
    docs = table([(1, None), (2, ""), (3, "7 + 8"), (4, "le chat " * 30_000), (None, "x"), (4, "a")], lang="fr")
    got = sorted((tuple(r)[1:4] for r in language.languages(docs.selectExpr("*", "1 AS lang_pred", "2 AS score")).collect()), key=str)
    assert [r[1] for r in got].count("und") == 3 and len(got) == 6 and all(0 <= r[2] <= 1 for r in got)
    assert language.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}

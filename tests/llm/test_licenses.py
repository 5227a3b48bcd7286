from opslens.llm import licenses, queries


def rows(spark, table, texts, **more):
    return [tuple(r)[:2] for r in licenses.licenses(table(list(enumerate(texts))), **more).collect()]


def test_notices_and_headers(spark, table):
    apache = licenses.TEMPLATES["Apache-2.0"]
    wrapped = "\n".join(apache[i:i + 70] for i in range(0, len(apache), 70))
    texts = ["Some prose.\nReleased under the MIT License.\nMore prose.", "Intro words go here. " + apache, "The license of the river is under the bridge.",
             "Licensed under CC BY-NC 4.0.", apache.replace("obtain", "get").upper(), "# code\n" + wrapped]
    got = rows(spark, table, texts)
    assert (0, "MIT-notice") in got and (3, "CC-BY-NC-4.0-notice") in got and (1, "Apache-2.0") in got and (4, "Apache-2.0") in got
    assert not [x for x in got if x[0] == 2]


def test_size_bounds_lose_nothing():
    m = licenses.Matcher(licenses.TEMPLATES)
    for text in list(licenses.TEMPLATES.values()) + ["licensed under the apache license", "the software is provided as is without warranty"]:
        own = licenses._bigrams(licenses.normalise(text))
        every = max(((2 * len(own & s) / (len(own) + len(s)), n) for n, s in m.sets.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        found = m.best(own)
        assert found[0] == every[0] if every[0] >= 0.8 else found[0] < 0.8


def test_query_finds_the_notices(spark, documents):
    got = {r.doc_id for r in queries.op6_licenses(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id for r in documents.collect() if any(t in r.text for t in ("Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
            "Licensed under the Apache License, Version 2.0.", "licensed under the GNU General Public License, version 3."))}
    assert got == want


def test_edge_cases(spark, table):
    notice = "Released under the MIT License."
    got = licenses.licenses(table([(1, None), (2, ""), (None, notice), (3, notice), (3, notice), (4, "word " * 60_000 + ".\n" + notice)]).selectExpr("*", "1 AS dice"))
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([None, 3, 3, 4], key=str)
    assert rows(spark, table, [notice], templates={}) == [] and rows(spark, table, [notice], templates={"x": ""}) == []
    assert licenses.licenses(table([(1, "a")]).limit(0)).count() == 0


def brute(m, text):
    """The choice among all windows of words."""
    words, found = licenses.normalise(text), []
    for a in range(len(words) - 1):
        for b in range(a + 2, len(words) + 1):
            own = licenses._bigrams(words[a:b])
            for n, s in m.sets.items():
                score = 2 * len(own & s) / (len(own) + len(s))
                if score >= m.dice:
                    found.append((len(own ^ s) - len(own & s), a - b, a, n, b, score))
    taken = []
    for _, _, a, n, b, score in sorted(found):
        if all(b <= x or a >= y for x, y, _, _ in taken):
            taken.append((a, b, n, score))
    return [(n, score) for _, _, n, score in sorted(taken)]


def test_windows_against_all_windows():
    import random

    draw = random.Random(3)
    m = licenses.Matcher({"x": "a b c d e f", "y": "c d e a b g h", "z": "f a b", "long": "a c e g b d f h a d g c f b e h"})
    many = 0
    for _ in range(150):
        parts = [draw.choice(["a b c d e f", "c d e a b g h", "a c e g b d f h a d g c f b e h", "q", "f a b", "a q b", "r s t", "a b"]) for _ in range(draw.randint(1, 7))]
        text = draw.choice([" ", ".\n"]).join(parts)
        got = [(n, s) for n, s, _, _ in m.scan(text)]
        many += len(got)
        assert got == brute(m, text), text
    assert many > 100


def test_foreign_lines_words_and_longer_sentences(spark, table):
    lines = [licenses.TEMPLATES["MIT"][i:i + 72] for i in range(0, len(licenses.TEMPLATES["MIT"]), 72)]
    words = licenses.TEMPLATES["Apache-2.0"].split()
    narrow = [" ".join(words[i:i + 3]) for i in range(0, len(words), 3)]
    narrow[6] = narrow[6].replace(narrow[6].split()[0], "changed")
    texts = ["\n".join([*lines[:7], "Page 3 of 12", *lines[7:]]), "\n".join(narrow),
             "All code samples in this article are released under the MIT License unless something else is said."]
    assert sorted(rows(spark, table, texts)) == [(0, "MIT"), (1, "Apache-2.0"), (2, "MIT-notice")]
    named = {"own": "Copyright NAME\nAll rights are kept by NAME and nobody may copy this work or any part of it"}
    assert rows(spark, table, [named["own"].replace("NAME", "Ann Example")], templates=named) == [(0, "own")]


def test_neighbours_get_their_own_names():
    m = licenses.Matcher(licenses.TEMPLATES)
    T = licenses.TEMPLATES
    best = lambda text: max(m.scan(text), key=lambda r: r[1], default=(None,))[0]
    for k in T:  # a template is found under its name or that of one with the same bigrams
        got = [r[0] for r in m.scan("Before it.\n" + T[k] + "\nAnd after.")]
        assert any(m.sets[g] == m.sets[k] for g in got), (k, got)
    for k in ("BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "AGPL-3.0-text", "GPL-3.0-text", "GPL-2.0-text", "MPL-2.0-text", "EPL-2.0-text"):
        words = T[k].split()
        words[len(words) // 2] = "altered"  # stays one match under its own name
        assert [r[0] for r in m.scan(" ".join(words))] == [k]
    for text, name in {"Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Released under the BSD License.": "BSD",
                       "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
                       "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
                       "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
                       "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0"}.items():
        assert best(text).split("-notice")[0] == name

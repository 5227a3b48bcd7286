import corpus_pipeline
from opslens.llm.simhash import fingerprint_of

from tests.llm.test_simhash import components

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_rules(spark):
    """Each stage's result from its own input, by a plain rule."""
    from opslens.llm.common import read_table, stage

    docs = read_table(spark, SF, "documents")
    marks = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(step(spark, docs, SF), f"test-{name}")
        after = out.collect()
        ids = {r.doc_id for r in after}
        if name != "token_ids":
            assert out.columns == docs.columns
            assert all(tuple(before[r.doc_id]) == tuple(r) for r in after)
        if name == "toxicity":
            gone = set(before) - ids
            assert sum(marks.get(d) == 1 for d in gone) >= 0.6 * sum(v == 1 for v in marks.values())
            assert not [d for d in gone if marks.get(d) == 0]
        if name == "simhash_dedup":
            prints = {d: fingerprint_of(r.text) & (1 << 64) - 1 for d, r in before.items()}
            low = components(list(before), [prints[d] for d in before])
            assert ids == set(low.values()) and len(after) == len(ids)
        if name == "decontamination":
            items = [r.text for r in read_table(spark, SF, "benchmark").collect()]
            flat = lambda t: " ".join(t.split())
            held = {d for d, r in before.items() if any(flat(i) in flat(r.text) for i in items if len(i.split()) >= 13)}
            assert held and not held & ids and len(set(before) - ids) <= 2 * len(held) + 2
        if name == "mixing":
            words = sum(len(r.text.split()) for r in after)
            assert abs(words / (0.8 * sum(len(r.text.split()) for r in before.values())) - 1) < 0.25
        if name == "token_ids":
            assert len(after) == sum(1 for _ in docs.collect()) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            last = max(after, key=lambda r: r.start)
            assert sum(r.n_tokens for r in after) == last.start + last.n_tokens
        docs = out


def test_run_of_empty_documents(spark, tmp_path):
    from opslens.llm.common import read_table

    for t in ("documents", "labels", "benchmark"):
        read_table(spark, "/root/testdata/sf0.001", t).limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

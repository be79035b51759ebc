import corpus_pipeline
from keepsake.llm import decontaminate, languages, mixing, shards, similar
from tests.llm.test_decontaminate import brute as edit_brute
from tests.llm.test_similar import brute as set_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    kept = docs
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.collect()
        kept = stage(spark, kept, SF)
        after = kept.collect()
        if number < 4:
            assert kept.columns == docs.columns
        ids = {r.doc_id for r in after}
        if number == 0:
            told = {r.doc_id: r for r in languages.predict(docs, languages.learn(docs)).collect()}
            assert ids == {k for k, r in told.items() if r.lang_pred != "und" and r.score >= 0.0625}
        elif number == 1:
            order = sorted(before, key=lambda r: r.doc_id)
            want = set_brute([r.text for r in order])
            assert ids == {order[i].doc_id for i, (n, c) in enumerate(want) if c == i}
        elif number == 2:
            normal = [decontaminate.normal(t) for t in items]
            gone = {r.doc_id for r in before} - ids
            for r in before:
                text = decontaminate.normal(r.text)
                if r.doc_id in gone:
                    assert any(edit_brute(i, text, int(len(i) * decontaminate.RATE)) for i in normal)
                else:
                    assert not any(i in text for i in normal)
        elif number == 3:
            sizes = {r.doc_id: len(r.text.encode().split()) for r in before}
            by = {}
            for r in before:
                by[r.source] = by.get(r.source, 0) + sizes[r.doc_id]
            want = dict(zip(sorted(by), mixing.targets([by[s] for s in sorted(by)])))
            got = {}
            for r in after:
                got[r.source] = got.get(r.source, 0) + sizes[r.doc_id]
            assert all(abs(got[s] - want[s]) <= 0.03 * want[s] + 10 for s in want)
        else:
            coder = shards.tokenizer(shards.VOCABULARY)
            assert sum(r.n_tokens for r in after) == sum(len(coder.encode_ordinary(r.text)) for r in before)


def test_run_is_the_stages_in_order(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "sequence", "n_tokens", "tokens_sha256").collect())) for _ in range(2))
    assert a == b and a

import brute
import corpus_pipeline
from support import listed
from test_packing import check

from weirline.llm import surrogates
from weirline.llm.common import materialise


def test_each_stage_works_on_what_the_one_before_kept(spark, sf_dir, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "best_fit_packing",
    ]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        done = stage(spark, docs, sf_dir)
        if name == "best_fit_packing":
            rows = [(i, r.text, r.source) for i, r in before.items()]
            check(rows, done.collect(), 2048, True)
            break
        docs = materialise(done, "stage")
        assert docs.columns == documents.columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            # The given documents are in one language each.
            assert after == before
        elif name == "ngram_jaccard_join":
            assert set(after) == {r[4] for r in brute.near_join(texts)}
        elif name == "benchmark_decontamination":
            assert set(after) == {r[0] for r in brute.decontaminate(texts, items) if not r[5]}
        else:
            assert set(after) == set(before)
            found = {r["_row"].doc_id for r in surrogates.replace(spark.createDataFrame(list(before.values())), "k").collect() if r["_kinds"]}
            assert {i for i, r in after.items() if r.text != before[i].text} == found
            assert all(r.n_chars == len(r.text) for i, r in after.items() if i in found)
        if name != "pii_surrogates":
            assert all(after[i] == before[i] for i in after)
    assert listed(corpus_pipeline.run(spark, sf_dir), "doc_id", "piece", "bin") == listed(done, "doc_id", "piece", "bin")


def test_language_stage_rejects(spark, sf_dir, documents):
    row = documents.first().asDict()
    odd = [row | {"doc_id": 10_000 + k, "text": t} for k, t in enumerate([None, "", "12345 ?!", row["text"]])]
    docs = documents.unionByName(spark.createDataFrame(odd, documents.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    assert {i for i in kept if i >= 10_000} == {10_003} and len(kept) == documents.count() + 1

"""The pipeline against the operators' brute-force versions, and on a small messy table."""

import hashlib

import pytest

import corpus_pipeline
from corpusloom.llm import common, quality, similar


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near duplicates", "decontamination", "tokens"]


def test_run_equals_its_parts(spark, sf):
    docs = common.table(spark, sf, "documents")
    net = quality.fit(docs, common.table(spark, sf, "labels"))
    kept = {r.doc_id: r.text for r in docs.collect()}
    scores = dict(zip(kept, quality.score_texts([t or "" for t in kept.values()], net)))
    kept = {d: t for d, t in sorted(kept.items()) if scores[d] >= 0.5}
    from tests.llm.test_operators import brute_lines

    out = {d: t for d, (t, n, gone) in brute_lines(list(kept.items())).items() if not gone or gone < n}
    from tests.llm.test_operators import brute_classes, words

    classes = brute_classes(list(out.items()))
    out = {d: t for d, t in out.items() if classes[d][0] == d}
    items = [words(r.text) for r in common.table(spark, sf, "benchmark").collect()]
    holds = lambda w, x: any(w[i : i + len(x)] == x for i in range(len(w) - len(x) + 1))
    out = {d: t for d, t in out.items() if not any(holds(words(t), x) for x in items)}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in out.items()}


@pytest.mark.parametrize("n", range(4))
def test_stages_keep_the_columns(spark, sf, n):
    docs = common.table(spark, sf, "documents")
    bad = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0)], docs.schema)
    got = corpus_pipeline.STAGES[n][1](spark, docs.unionByName(bad), sf)
    assert got.columns == docs.columns and got.count() > 0
    assert corpus_pipeline.STAGES[n][1](spark, docs.filter("false"), sf).count() == 0


def test_one_document_of_each_group(spark):
    rows = [(i, "copied text of well over five words in all") for i in (3, 1, 2)] + [(9, "another text of well over five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.one_of_each(df).collect()} == {1, 9}

"""The pipeline's stages against brute force, each on its own input."""

import zlib

import corpus_pipeline
from loomcast.llm import toxicity
from loomcast.llm.common import table
from test_near_dedup import brute_groups
from test_packing import check


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    frames = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        frames[name] = at.cache()
        if name != "packing":
            assert at.columns == docs.columns
            assert all(rows[r.doc_id] == r for r in at.collect())  # what stays, stays as it is
    left = {n: {r.doc_id: r.text for r in f.collect()} for n, f in frames.items() if n != "packing"}
    learn = [(i, r.text, labels[i]) for i, r in rows.items() if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    scorer = toxicity.fit_sample(sorted(learn)).scorer()
    assert set(left["toxicity"]) == {i for i, r in rows.items() if scorer.score(r.text) < 0.7}
    best = {}
    for i, t in left["toxicity"].items():
        best[t] = max(i, best.get(t, -1))
    assert set(left["exact_dedup"]) == set(best.values())
    assert set(left["near_dedup"]) == {i for i, (_, c) in brute_groups(left["exact_dedup"]).items() if i == c}
    check(frames["packing"].collect(), left["near_dedup"])
    assert corpus_pipeline.run(spark, sf).count() == frames["packing"].count()
    for f in frames.values():
        f.unpersist()


def test_clashing_columns_and_empty(spark, sf):
    docs = table(spark, sf, "documents")
    odd = docs.selectExpr("*", "doc_id AS _id", "text AS _t", "1 AS n", "'x' AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns and 0 < got.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0

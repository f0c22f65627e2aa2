import corpus_pipeline
from marginalia.llm import common


def test_pipeline(spark, tricky, empty):
    docs = common.table(spark, tricky, "documents")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = common.stored(stage(spark, kept, tricky), f"test-{name}")
        sizes.append(kept.count())
        assert kept.columns[: len(docs.columns)] == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert not {3000, 3001, 3002, 3003} & set(ids)  # no letters
    assert not set(range(1001, 1030)) & set(ids)  # copies
    assert len(set(range(2000, 2030)) & set(ids)) <= 1  # near copies
    assert not {6000, 6001, 6002, 6003, 6010} & set(ids)  # leaks
    clean = [r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 120]
    assert len(set(clean) & set(ids)) > 60
    assert all(1 <= r["copies"] <= 2 for r in kept.collect())
    assert corpus_pipeline.run(spark, empty).collect() == []

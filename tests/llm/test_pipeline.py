import corpus_pipeline
from tidemark.llm.registry import QUERIES


def test_stages(spark, sf, docs):
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf).cache()
        seen[name] = (now, after)
        if name != "token_ids":
            assert after.columns == docs.columns
            assert after.count() <= now.count() and after.select("doc_id").distinct().count() == after.count()
        now = after
    assert seen["language"][1].count() >= 0.97 * docs.count()
    assert now.count() == seen["token_ids"][0].count()
    starts = sorted((r.start, r.n_tokens) for r in now.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, now.collect()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

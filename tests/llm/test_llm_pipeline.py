"""The corpus pipeline and the contracts of its queries."""

import corpus_pipeline
from llm_fixtures import SF001, no_docs, odd_docs  # noqa: F401

from voltsight.llm import decontam, langid, mixing, queries, sharding
from voltsight.llm.common import table


def test_stages_keep_columns_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == docs.count()


def test_pipeline_equals_plain_stages(spark):
    """Decisions of each stage, recomputed plainly from the stage's own input."""
    from test_llm_operators import plain_components, plain_fingerprint
    docs = table(spark, SF001, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    spoken = {r.doc_id for r in langid.identified(docs).collect() if r.lang_pred != "und" and not r.ambiguous}
    roots = plain_components({d: plain_fingerprint(rows[d].text) for d in spoken})
    single = {d for d in spoken if roots[d] == d}
    bench = [(r.item_id, r.text) for r in table(spark, SF001, "benchmark").collect()]
    clean = {d for d in single if decontam.brute_force(rows[d].text, bench)[0] == 0}
    left = docs.where(docs.doc_id.isin(sorted(clean)))
    taken = {r.doc_id for r in mixing.assignments(left, weights=corpus_pipeline.WEIGHTS, epochs=1,
                                                  share=corpus_pipeline.MIX_SHARE).collect() if r.copies}
    assert len(spoken) > len(single) > len(clean) > len(taken) > 0.6 * len(spoken)
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.balanced_shards(docs.where(docs.doc_id.isin(sorted(taken)))).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF001).collect()} == want


def test_query_columns(spark):
    head = {"op1": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            "op2": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            "op3": ["doc_id", "held_out", "lang_pred", "score"],
            "op5": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            "op8": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            "op9": ["query_id", "rank", "vec_id", "score"], "op10": ["doc_id", "fingerprint", "component_id"]}
    names = {n.split("_")[0]: n for n in queries.QUERIES if n.startswith("op")}
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    for n, want in head.items():
        df = queries.QUERIES[names[n]](spark, SF001)
        assert df.columns[:len(want)] == want
        assert df.count() > 0

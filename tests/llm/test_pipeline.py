"""The pipeline: each stage against a plain version of its decision."""

import hashlib

import corpus_pipeline
from messy import documents, empty
from test_llm import library_, plain_hits

from turnstone.llm import attention_quality, order_minhash
from turnstone.llm.common import written
from turnstone.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "encode":
            assert docs.columns == columns
        if name == "quality":
            model = attention_quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
            scores = model.score(*attention_quality.encode_passages([t.encode() for t in before.values()]))
            assert set(after) == {k for k, s in zip(before, scores) if s >= 0.3}
        if name == "exact_dedup":
            last = {}
            for k in sorted(before):
                last[before[k].encode().lower()] = k
            assert set(after) == set(last.values())
        if name == "near_dedup":
            lost = set(before) - set(after)
            near = lambda a, b: order_minhash.edits_within(a, b, order_minhash.limit_of(max(len(a), len(b)), 0.8)) is not None
            ids = {k: order_minhash.word_ids(order_minhash.words_of(t.encode())) for k, t in before.items()}
            assert all(any(near(ids[k], ids[j]) for j in before if j != k) for k in lost)
        if name == "decontaminate":
            assert set(after) == {k for k, t in before.items() if not plain_hits(t, items)[-1]}
        if name == "encode":
            for k, r in after.items():
                assert r.n_tokens == len(library_().encode_ordinary(before[k]))
                assert r.decoded_sha256 == hashlib.sha256(before[k].encode()).hexdigest()


def test_awkward_rows_and_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark), SF).count() > 0
        assert stage(spark, empty(spark), SF).count() == 0


def test_clean_texts_under_the_id_of_a_contaminated_one_stay(spark):
    item = max((r.text for r in table(spark, SF, "benchmark").collect()), key=len)
    rows = [(None, item), (None, "a clean text without an id"), (None, None), (7, item), (7, "a clean text under the same id"), (8, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()}
    assert got == {rows[1], rows[2], rows[4]}

import corpus_pipeline as cp
from variform.llm.common import table
from variform.llm.decontaminate import Bm25Index
from variform.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_ten_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    n = docs.count()
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF).cache()
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        assert out.count() <= n and out.select("doc_id").distinct().count() == out.count()
        docs, n = out, out.count()
    assert docs.where("NOT round_trip").count() == 0
    index = Bm25Index([(r.item_id, r.text, None) for r in table(spark, SF, "benchmark").collect()])
    assert not any(index.search(r.text) for r in docs.collect())


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0

import corpus_pipeline as P
from siftline.llm import decontaminate, jaccard_join, quality_rules


def test_stages_on_small_data(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        ids = {r[0] for r in before.select(before.columns[0]).collect()}
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality_rules.rule_report(before).filter("kept").collect()}
        if name == "jaccard_join":
            report = jaccard_join.jaccard_report(before, k=5, similar=80).collect()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in report}
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == ids - bad
        if name != "token_shards":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} <= ids
    assert docs.count() > 0

from __future__ import annotations

import corpus_pipeline
from cutpoint.llm import near_copies
from cutpoint.llm.queries import op3_quality_rules

FOLDER = "/root/testdata/sf0.001"


def test_stages(llm_spark):
    docs = llm_spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, given = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(llm_spark, given, FOLDER)
        made = corpus_pipeline.settle(made)
        if name != "pieces":
            assert made.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in op3_quality_rules(llm_spark, FOLDER).where("kept").collect()}
            assert {r["doc_id"] for r in made.collect()} == kept
        if name == "near_copies":
            assert made.count() == near_copies.classes(given, carry=["doc_id"]).select("class").distinct().count()
        counts.append(made.count())
        given = made
    assert given.where("NOT exact").count() == 0
    assert corpus_pipeline.run(llm_spark, FOLDER).count() == counts[-1]

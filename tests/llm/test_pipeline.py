"""The pipeline, stage by stage, and that other queries do without this subpackage."""

from collections import Counter

import __spark_entry__ as driver
import corpus_pipeline
from larder.llm import exact, quality, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, small):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).checkpoint()
        assert kept.columns == columns and 0 < kept.count()
        if name != "mix":
            assert not Counter(r.doc_id for r in kept.collect()) - Counter(r.doc_id for r in before.collect())
    assert corpus_pipeline.packing_stage(spark, kept, FOLDER).agg({"length": "sum"}).first()[0] > 0


def test_pipeline_stages_do_what_their_operators_say(spark, small):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").selectExpr("doc_id", "quality AS label")
    good = {r.doc_id for r in quality.scored(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, FOLDER).collect()} == good
    assert {r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, FOLDER).collect()} == {r.doc_id for r in exact.mark_copies(docs).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()} == {r.component_id for r in simhash.near_groups(docs, words=3).collect()}


def test_run_is_the_stages(spark, small):
    rows = driver.queries()["pipeline"](spark, FOLDER)
    assert rows.count() > 0 and "pipeline" not in driver.oracle_sql()
    numbers = sorted(int(name[2:].split("_")[0]) for name in driver.queries() if name.startswith("op") and name[2].isdigit())
    assert numbers == list(range(1, 14))

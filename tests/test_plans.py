"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import plan_of
from topicweir.operators import classify, dataset, keywords
from topicweir.plans import queries
from topicweir.runtime import Scratch, literal_table, settle, spread, write_once

TRAINING = {"train_teacher", "train_student", "distill", "train_job"}


@pytest.fixture(scope="module")
def plans(spark, sf):
    return {k: plan_of(q(spark, sf)) for k, q in queries.QUERIES.items() if k not in TRAINING}


def test_no_pairwise_joins_and_no_row_functions(plans):
    for name, plan in plans.items():
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert node not in plan, (name, node)


def test_scans_read_needed_columns_only(plans):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plans["class_distribution"]) == ["lang:string"]
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plans["timing_summary"]) == ["n_chars:bigint"]
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plans["confidence_summary"]) == ["doc_id:bigint,text:string"]


def test_scoring_is_narrow(spark, sf):
    docs = queries.table(spark, sf, "documents")
    for df in (
        classify.keyword_classify(docs, queries.WORDS),
        classify.cascade_classify(docs, queries.WORDS, queries.with_model),
        keywords.doc_keywords(docs),
        queries.features.keyword_features(docs, queries.MIXED_CASE),
        queries.features.stat_features(docs),
    ):
        assert "Exchange" not in plan_of(df)


def test_filter_on_a_score_stays_above_the_score(spark, sf):
    docs = queries.table(spark, sf, "documents")
    scored = settle(classify.keyword_classify(docs, queries.WORDS), "subject", "confidence")
    plan = plan_of(scored.filter("subject = 'en' and lang = 'en'"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert plan.count("regexp_extract_all") == 1


def test_top_terms_are_cut_before_the_class_meets(plans):
    for name in ("class_keywords", "deck_text", "merge_dict"):
        assert plans[name].index("WindowGroupLimit") < plans[name].rindex("WindowGroupLimit")


def test_class_filter_reaches_the_scan(spark, sf):
    rows = queries.labelled_ids(spark, sf)
    plan = plan_of(dataset.limit_per_class(rows, ["en", "fr"], 3))
    assert "PushedFilters: [In(lang, [en,fr])" in plan


def test_results_that_nobody_reads_are_not_computed(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text")
    for rows in (classify.keyword_classify(docs, queries.WORDS), queries.with_model(docs), classify.cascade_classify(docs, queries.WORDS, queries.with_model)):
        plan = plan_of(rows.select("doc_id"))
        assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["doc_id:bigint"] and "regexp" not in plan


def test_runtime_helpers(spark, sf):
    docs = queries.table(spark, sf, "documents")
    slots = spark.sparkContext.defaultParallelism
    assert spread(docs, "doc_id").rdd.getNumPartitions() == slots
    many = spark.range(0, 100, 1, slots + 3)
    assert spread(many, "id") is many
    written = write_once(many, "t")
    assert written.count() == 100 and "parquet" in plan_of(written).lower()
    table = literal_table(spark, [("a'\"\n", 1, None)], ["s", "i", "d"], ["string", "int", "double"])
    assert [tuple(r) for r in table.collect()] == [("a'\"\n", 1, None)]
    assert settle(many.withColumn("x", F.col("id") * 2), "x").filter("x = 4").first().id == 2


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(queries.QUERIES) <= set(contract.oracle_sql()) & set(contract.queries())
    out = contract.entry(spark)
    assert out.columns == ["subject", "ord", "n", "percent"] and out.count() > 0


def test_split_reads_its_input_once(spark, sf):
    rows = queries.labelled_ids(spark, sf, "text")
    plan = plan_of(dataset.stratified_split(rows, queries.SUBJECTS))
    assert plan.count("FileScan") == 1 and "Window" not in plan


def test_scratch_tables_are_removed(spark, tmp_path):
    import glob

    spark_dir = spark.conf.get("spark.checkpoint.dir")
    with Scratch(spark, "probe") as scratch:
        kept = scratch.table(spark.range(10), "a")
        assert kept.count() == 10 and glob.glob(f"{spark_dir}/probe-*/a/*.parquet")
        scratch.drop("a")
        assert not glob.glob(f"{spark_dir}/probe-*/a")
    assert not glob.glob(f"{spark_dir}/probe-*")


def test_training_queries_grow_the_whole_teacher(spark, sf, monkeypatch):
    asked = []

    class Stop(Exception):
        pass

    def fit(df, rounds, depth, *_):
        asked.append((rounds, depth))
        raise Stop

    import topicweir.operators.training as training

    monkeypatch.setattr(training, "fit_boosted", fit)
    for name in ("train_teacher", "distill", "train_job"):
        try:
            queries.QUERIES[name](spark, sf)
        except Stop:
            pass
    assert asked == [(100, 6)] * 3

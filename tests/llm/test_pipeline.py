"""The pipeline, stage by stage, against what each stage must have done."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from brightwake.llm import simhash, toxicity
from brightwake.llm.scratch import made, written


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], data), f"test-{name}"))
    raw, clean, unique, private, mixed, packed = kept
    assert all(x.columns == names for x in kept[:-1])
    scores = toxicity.toxicity_query(raw, spark.read.parquet(f"{data}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}
    groups = simhash.simhash_query(clean)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())
    assert private.count() == unique.count() and private.where("text rlike '[a-z]@mail[0-9]'").count() == 0
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in private.collect()}
    per_doc = packed.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in per_doc} == {r.doc_id for r in mixed.collect()}


def test_columns_with_the_operators_own_names(spark, data):
    """Columns named like the stages' helpers come through every stage as they are."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    names = ["__text", "__score", "__key", "__row", "__copies", "__each", "__part", "__hash", "__none", "__id", "__kept", "__base", "__cand", "__spans", "__read", "__all", "fp", "root", "score", "n", "size", "tag"]
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data), f"clash-{name}")
        assert set(docs.columns) >= set(names) and docs.count() > 0
        assert docs.where(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0


def test_run_leaves_only_what_its_result_reads(spark, data):
    before = made()
    assert corpus_pipeline.run(spark, data).count() > 0
    left = [p for p in made() if p not in before]
    assert len(left) == 1 and "pipeline-mixing" in left[0]


def test_run_on_an_empty_table(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

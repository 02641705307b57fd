from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from voxelmill.llm import queries

from . import cases


def test_stages_on_odd_documents(spark, tmp_path):
    docs = cases.frame(spark).drop("n", "block", "digest", "size", "fp", "chunk", "target", "__x")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        docs = out
    assert docs.count() > 0


def test_stages_on_no_documents(spark, tmp_path):
    docs = cases.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_pipeline_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    squeezed = lambda df: Counter("".join(r[0].split()) for r in df.select("text").collect())
    assert set(squeezed(kept).values()) == {1} and set(squeezed(kept)) == set(squeezed(docs))
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} <= {r[0] for r in kept.select("doc_id").collect()}


def test_queries_are_registered(spark, sf_dir):
    found = entry.queries()
    assert set(queries.QUERIES) <= set(found) and "pipeline" in found
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    for name in ("op2_exact_dedup", "op4_license_scan"):
        assert name in entry.oracle_sql()

"""The pipeline's stages keep the documents' columns, and their decisions take effect."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_store"]
    assert 200 > counts[0] > counts[1] >= counts[2] > 100 and counts[3] == counts[4]
    assert docs.where(~F.col("verified")).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf_dir, clashing, tmp_path):
    """Rows without id, text or source, repeated rows and columns named like the operators' own come through."""
    first = clashing.limit(1)
    docs = clashing.unionByName(first).unionByName(first.withColumns({c: F.lit(None).cast(t) for c, t in first.dtypes}))
    docs = docs.unionByName(first.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("no id but a text of its own, with words that stand in none of the others")}))
    docs.write.parquet(f"file://{tmp_path}/given")
    docs = spark.read.parquet(f"file://{tmp_path}/given")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        kept.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.where("text LIKE 'no id but%'").count() >= 1, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("verified").count() == docs.count()


def test_stages_take_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0

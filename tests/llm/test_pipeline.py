"""The stages of the corpus pipeline in order, each against what it must do to its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from slotgrid.llm import decontam, quality, simhash


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if i < 4:
            assert seen[-1].columns == docs.columns
    good = {r[0] for r in quality.score_documents(docs, labels).where("quality_score.predicted = 1").select("doc_id").collect()}
    assert {r[0] for r in seen[1].select("doc_id").collect()} == good
    assert seen[2].where("length(text) > n_chars").count() == 0 and 0 < seen[2].count() <= seen[1].count()
    groups = simhash.near_duplicates(seen[2])
    assert sorted(r[0] for r in seen[3].select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    assert decontam.find_contamination(seen[4], bench).where("contamination.n_hit > 0").count() == 0
    assert seen[5].count() == seen[4].count() and seen[5].where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()


def test_stages_on_hard_rows(spark, sf):
    """Nulls, empty and repeated rows, and an empty table pass every stage; columns stay those of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None, None), (7, "", "en", "web", 0), (7, "", "en", "web", 0), (8, None, "de", None, None), (8, "some words\n\nsome words that stay", None, "web", 32), (None, "a text without an id, of a few words", "en", "web", 36)]
    hard = spark.createDataFrame(odd, docs.schema)
    for df in (docs.limit(40).unionByName(hard), hard, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, sf)
            assert i == 4 or out.columns == docs.columns
            assert out.count() <= df.count()


def test_quality_stage_keeps_what_is_good(spark, sf):
    """The stage keeps exactly the rows whose own statistics, scored one by one by a forest fitted here, reach the limit."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(docs, labels, "doc_id", "text", "quality")
    import numpy as np

    want = sorted(r["doc_id"] for r in docs.select("doc_id", "text").collect() if forest.score(np.array([quality.statistics(r["text"])]))[0] >= quality.THRESHOLD)
    assert sorted(r[0] for r in corpus_pipeline.quality_stage(spark, docs, sf).select("doc_id").collect()) == want

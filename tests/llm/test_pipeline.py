import os

import pytest

import corpus_pipeline
from llm_cases import EDGES, frame

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_edge_rows(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, EDGES).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r["doc_id"] for r in docs.collect()} <= {4, 5, 7, 8, None}
    assert corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).count() >= docs.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")
def test_whole_run_keeps_clean_documents(spark):
    packed = corpus_pipeline.run(spark, SF_DIR).toPandas()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = docs.join(labels.filter("quality = 1"), "doc_id").select("doc_id", "text").toPandas()
    single = texts.drop_duplicates("text")
    assert len(set(single.doc_id) & set(packed.doc_id)) >= 0.85 * len(single)
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (2, "", None)]])
def test_nothing_to_keep(spark, tmp_path, rows):
    """An empty table, and one of which nothing is kept, go through all stages and give no rows."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

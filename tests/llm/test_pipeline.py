"""The corpus pipeline, stage by stage, on a small fixture."""

import corpus_pipeline
from kinweave.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        path = corpus_pipeline.materialise(out, name)
        if name != "mix":
            assert path.count() <= n
            assert path.select("doc_id").distinct().count() == path.count()
        n, docs = path.count(), path
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and last.filter("size(ids) <> n_tokens").count() == 0


def test_registry():
    names = set(registry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names - {"pipeline"}}
    assert set(registry.oracle_sql()) <= names

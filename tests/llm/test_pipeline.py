import json
from collections import Counter
from types import SimpleNamespace

import pytest

import corpus_pipeline
from tellurion.llm import queries
from tellurion.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_run_in_order_and_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(out.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
            docs = out
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3]
    again = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in out.collect())


def test_the_pipeline_takes_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    for n, frame in enumerate((odd, empty)):
        docs = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
        assert (docs.count() > 0) == (n == 0)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert json.dumps(sorted(queries.ORACLE_SQL))


def test_a_cluster_must_name_a_shared_folder():
    """No machine-local folder takes its place."""
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)

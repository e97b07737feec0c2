"""The pipeline on the smallest tables, stage by stage against what its operators say."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from scriptorium.llm import quality_rules, simhash
from scriptorium.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_names():
    assert [int(name[2:].split("_")[0]) for name in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, labels = docs.columns, dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {row["doc_id"] for row in docs.select("doc_id").collect()}
        stage(spark, docs, SF_DIR).write.parquet(out := str(tmp_path / str(number)))
        after = spark.read.parquet(out)
        kept = {row["doc_id"] for row in after.select("doc_id").collect()}
        assert kept <= before
        if name == "quality_rules":
            judged = quality_rules.judge(docs).filter("kept").select("doc_id").collect()
            assert kept == {row["doc_id"] for row in judged}
            assert sum(labels.get(k) == 0 for k in kept) <= 0.1 * sum(v == 0 for v in labels.values())
        if name == "quality_classifier":
            assert sum(labels.get(k) == 1 for k in before - kept) <= 0.02 * sum(labels.get(k) == 1 for k in before)
        if name == "simhash_near_dedup":
            assert kept == {row["component_id"] for row in simhash.near_duplicates(docs, "doc_id").collect()}
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        else:
            rows = after.toPandas()
            assert kept == before
            for _, group in rows.sort_values("offset").groupby("sequence_id"):
                assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
        docs = after
    whole = corpus_pipeline.run(spark, SF_DIR).toPandas()
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[pieces].values)) == sorted(map(tuple, rows[pieces].values))

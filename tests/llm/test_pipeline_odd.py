"""Every stage of the pipeline on odd rows and on empty tables, and the whole pipeline on an empty folder."""

from __future__ import annotations

import hashlib

import brute
import corpus_pipeline
import pytest
from test_operators import SCHEMA, odd_rows

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, "a passage that is nowhere to be found in any of these texts"), (1, None), (None, "x"), (2, "")], ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_odd_rows_and_none(spark, folder):
    """Null ids and texts, empty and very long texts, repeated rows, clashing names: columns stay, rows come from the input."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, folder)
            found = out.collect()
            if name != "byte_level_bpe":
                assert out.columns == docs.columns
                ids = [r[0] for r in rows]
                assert all(r.doc_id in ids for r in found)
            if table is not docs:
                assert found == []
            elif name == "line_dedup":
                texts = brute.spread_lines([(r[0], r[1], r[3]) for r in rows], corpus_pipeline.MIN_SITES)
                assert {t for t in texts if t} >= {r.text for r in found if r.text}
            elif name == "benchmark_decontamination":
                assert len(found) == len(rows) - sum("x" in (r[1] or "").lower().split() for r in rows if r[0] is not None)
            elif name == "byte_level_bpe":
                want = sorted((repr(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
                assert sorted((repr(r.doc_id), r.decoded_sha256) for r in found) == want


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

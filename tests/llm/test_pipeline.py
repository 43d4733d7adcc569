"""The corpus pipeline stage by stage against plain versions of its stages, and its entry points."""

from __future__ import annotations

import hashlib

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from oracle import compare, connect

from biotope.llm.bpe import read_ranks
from biotope.llm.decontaminate import ERROR_RATE, MIN_CHARS, normalized
from biotope.llm.queries import ORACLES, QUERIES
from biotope.session import materialize

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [normalized(t) for (t,) in duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()]
    before, kept = rows_of(docs), {}
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "byte_level_bpe" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        now = rows_of(docs)
        assert set(now) <= set(before)
        if name != "byte_level_bpe":
            assert docs.columns == columns and docs.count() == len(now)
        if name == "quality_rules":
            for i, r in before.items():
                n, _, _, _, repeat = brute.base_figures(r.text)
                if n < 50 or 2 * repeat > n:
                    assert i not in now
            good = {i for i, q in duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall() if q == 1}
            good = {i for i in good if len(brute.WORDS.findall(before[i].text)) >= 50}
            assert good <= set(now)
        if name == "line_dedup":
            wanted = brute.spread_lines([(r.doc_id, r.text, r.source) for r in before.values()], corpus_pipeline.MIN_SITES)
            left = {r.doc_id: t for r, t in zip(before.values(), wanted, strict=True) if t == r.text or brute.WORDS.search(t)}
            assert {i: r.text for i, r in now.items()} == left
        if name == "ngram_jaccard_join":
            groups = brute.jaccard_components([(r.doc_id, r.text) for r in before.values()])
            assert set(now) == {c for _, _, c in groups} and {i: r.text for i, r in now.items()} == {i: before[i].text for i in now}
        if name == "benchmark_decontamination":
            for i, r in before.items():
                body = normalized(r.text)
                if any(t in body for t in items if len(t) >= MIN_CHARS):
                    assert i not in now
                elif i not in now:
                    assert any(brute.edit_distance_within(t, body) <= ERROR_RATE * len(t) for t in items)
        if name == "byte_level_bpe":
            tiktoken = pytest.importorskip("tiktoken")
            peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            assert set(now) == set(before)
            for i, r in now.items():
                ids = peer.encode_ordinary(before[i].text)
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
        before, kept = now, docs
    assert sorted(map(repr, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(repr, kept.collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    result = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert result["problems"] == [] and result["rows"] > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None

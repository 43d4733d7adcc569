"""Ranked search against a plain ranking of all documents, and the bounds of blocks against all scores."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

from biotope.llm import blocked_search
from biotope.llm.blocked_search import build_shard, ranked_search, scores, search_shard
from biotope.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
FOLDER = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, top=20):
    docs = [(name, Counter(terms(t)), len(terms(t))) for name, t in documents if terms(t)]
    n_docs, length = len(docs), sum(d[2] for d in docs)
    held = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for name, c, n in docs:
            m = 75 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, name is not None, name))
        out += [(item, k + 1, name, -s) for k, (s, _, name) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def result(spark, documents, items, top=20):
    docs = spark.createDataFrame([(n, t, "x", 1) for n, t in documents], "doc_id long, text string, item_id string, score int")
    asked = spark.createDataFrame([(n, t, "x", 1) for n, t in items], "item_id long, text string, doc_id string, rank int")
    return sorted((tuple(r) for r in ranked_search(docs, asked, top).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    return docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


def test_odd_rows(spark):
    """Null, empty and very long texts, null and repeated ids, repeated rows and items, ties, letters beyond ASCII, no terms."""
    docs = [(k, "Alpha beta" if k % 3 else "alpha, ALPHA; gamma") for k in range(60)]
    docs += [(7, "alpha beta"), (None, "beta only"), (None, None), (61, ""), (62, "\x00 !?"), (63, "Übung übung 3x"), (64, "word " * 50_000 + "delta"), (5, "zeta")]
    items = [(1, "alpha beta"), (1, "beta"), (2, None), (3, "!!"), (None, "delta zeta"), (4, "Übung Übung 3X"), (5, "nowhere"), (6, "beta beta gamma " * 2000)]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, docs, items, top=3) == brute(docs, items, 3)


def test_empty(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a")], []) == []
    assert result(spark, [(1, None)], [(1, "a"), (2, None)]) == []


def test_small_shards_and_blocks_of_items(spark, monkeypatch, tables):
    """The same ranking from shards of 16 documents, blocks of three, several blocks of items, and without pairs."""
    docs, items = tables
    for name, value in {"SHARD_DOCS": 16, "BLOCK": 3, "ITEM_BYTES": 3000, "TERM_PAIRS": 0}.items():
        monkeypatch.setattr(blocked_search, name, value)
    assert result(spark, docs[:120], items[:30]) == brute(docs[:120], items[:30])


def test_matches_oracle(spark):
    found = compare(QUERIES["op13_blocked_search"](spark, FOLDER), connect(FOLDER), ORACLES["op13_blocked_search"])
    assert found["problems"] == [] and found["rows"] > 0


def test_blocks_below_the_bound_are_skipped():
    """Two kinds of documents, in the order of likeness: a query of one kind leaves blocks of the other closed, and loses nothing."""
    rng = np.random.default_rng(4)
    rows, size = 400, 60
    row = np.repeat(np.arange(rows), 12)
    term = np.concatenate([np.sort(rng.choice(30, 10, False) + 30 * (k >= 200)).tolist() + [58, 59] if k < 200 else np.sort(rng.choice(30, 12, False) + 30).tolist() for k in range(rows)])
    value = rng.integers(1, 1000, len(row)) * np.where(term < 55, 10, 1)
    shard = build_shard(rows, row, term, value, size, None, block=8)
    for terms_ in (np.array([3, 5, 9, 58, 59]), np.array([31, 40, 58])):
        query = np.zeros(size, np.int64)
        query[terms_] = 1, *([2] * (len(terms_) - 1))
        table = np.zeros((rows, size), np.int64)
        table[row, term] = value
        all_scores = table @ query
        found, got, opened = search_shard(shard, terms_, query, 1, 20, False)
        assert (got == all_scores[found]).all() and (scores(shard, found, query) == got).all()
        limit = np.sort(all_scores)[-20]
        assert set(np.flatnonzero(all_scores >= max(1, limit))) <= set(found.tolist())
        assert opened < np.isin(shard.block_term, terms_).sum()

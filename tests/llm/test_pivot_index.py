"""Near-copies of vectors against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotope.llm import pivot_index
from biotope.llm.pivot_index import choose_pivots, near_copies, pivot_count

SCHEMA = "vec_id long, embedding array<float>, label int, class string, root long"


def brute(rows, cosine=0.95):
    """{row number: (links, smallest reachable id)}."""
    units = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        good = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        units.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[find(k)] = min(least.get(find(k), name), name)
    return sorted(((name, links[k], least.get(find(k)), name == least.get(find(k))) for k, (name, _) in enumerate(rows)), key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(name, v, 1, "x", 5) for name, v in rows], SCHEMA)
    return sorted((tuple(r) for r in near_copies(df).collect()), key=repr)


def turned(rng, v, cosine):
    z = rng.normal(size=len(v))
    z -= z @ v * v / (v @ v)
    v = v / np.linalg.norm(v)
    return cosine * v + np.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


@pytest.mark.parametrize("block", [2048, 16])
def test_against_all_cosines(spark, monkeypatch, block):
    """Groups of near-copies with a third of all rows, at cosines around the limit, in one block and in many."""
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    vectors = [*base, *[turned(rng, base[0], c) for c in rng.uniform(0.97, 0.999, 60)], *[turned(rng, base[k], c) for k in range(1, 13) for c in (0.94, 0.945, 0.955, 0.96)]]
    rows = [(int(k), [float(np.float32(c)) for c in v]) for k, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Null, empty and zero vectors, null and non-finite components, repeated ids, null ids, huge and tiny values, other lengths."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
        (8, [2.0, 4.0]), (None, [1.0, 2.0]), (None, [-5.0, 1.0]), (9, [3e38, 3e38]), (10, [1e-38, 1e-38]), (11, [1.0, 2.0, 0.0]), (12, [-0.0, 1.0]),
        (13, [0.0, 1.0]), (14, [1.0]), (15, [-1.0]), (15, [2.0]), (16, [0.3, 1.0]),
    ]
    want = brute([(n, None if v is None else v) for n, v in rows])
    assert [r[:3] for r in result(spark, rows)] == [r[:3] for r in want]
    assert {r[3] for r in result(spark, rows) if r[0] is None} == {False, True}


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_pivots_are_bounded_and_apart(spark):
    assert pivot_count(10) == 256 and pivot_count(51_282) == 1024 and pivot_count(10**12) == pivot_index.MOST_PIVOTS
    rng = np.random.default_rng(0)
    units = [v / np.linalg.norm(v) for v in np.concatenate([rng.normal(size=(40, 8)), np.ones((40, 8)) + rng.normal(size=(40, 8)) / 50])]
    table = spark.createDataFrame([(bytes([k]), bytearray(v.tobytes())) for k, v in enumerate(units)], "key binary, unit binary")
    found = choose_pivots(table, 30)
    near = found @ found.T - np.eye(len(found))
    assert len(found) <= 30 and near.max() <= pivot_index.PIVOT_COSINE


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table.limit(300).collect()]
    rows += [(1000 + k, [float(c) for c in turned(rng, np.array(v), 0.951)]) for k, (_, v) in enumerate(rows[:150])]
    links = sum(r[1] for r in brute(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert near_copies(df).agg(F.sum("n_links")).first()[0] >= 0.98 * links

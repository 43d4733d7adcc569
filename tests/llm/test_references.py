"""Language references are counted exactly and kept for every language with enough words."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from test_operators import words

from biotope.llm import quality_rules, texts
from biotope.llm.quality_rules import fit_references

U = np.uint64


def hashed(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(texts.hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def test_common_words_do_not_hang_on_the_layout(spark):
    rng = random.Random(11)
    bodies = [" ".join(dict.fromkeys(f"w{int(rng.paretovariate(0.7))}" for _ in range(60))) for _ in range(200)]
    bodies.append("junk junk junk junk")
    count = Counter(w for b in bodies for w in b.split())
    least = sorted(count.values(), reverse=True)[63]
    sure = {hashed(w) for w, n in count.items() if n > least}
    df = spark.createDataFrame([(k, b, "en") for k, b in enumerate(bodies)], "doc_id long, text string, lang string")
    found = []
    for parts in (1, 100):
        found.append(fit_references(df.repartition(parts, "doc_id")))
        assert sure <= set(found[-1].words.tolist()) and len(found[-1].words) == 64
        assert hashed("junk") not in found[-1].words or count["junk"] >= least
    assert found[0].words.tolist() == found[1].words.tolist() and np.allclose(found[0].classes, found[1].classes)


def test_sparse_distances_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (30, 12)) * rng.integers(0, 2, (30, 12))
    counts[4] = 0
    q = rng.random((5, 12)) * rng.integers(0, 2, (5, 12))
    q /= q.sum(axis=1, keepdims=True)
    row, word = np.nonzero(counts)
    for most in (1, 40, 1 << 20):
        monkeypatch.setattr(quality_rules, "PAIRS", most)
        shares = quality_rules.References([*"abcde"], np.zeros((5, 8)), np.zeros(11, U), q).shares
        found = quality_rules.word_distances(row, word, counts[row, word], 30, 5, shares)
        assert np.allclose(found, quality_rules.distances(counts, q), atol=1e-7)


def test_every_language_with_enough_words_has_a_reference(spark):
    rng = random.Random(12)
    rows = []
    for k in range(70):
        common = [f"l{k}c{j}" for j in range(8)]
        for copy in range(6 if k < 69 else 5):
            rows.append((f"l{k}", " ".join(rng.choice(common) if rng.random() < 0.5 else words(rng, 1) + str(rng.random()) for _ in range(200)), k * 10 + copy))
    rows += [("rare", " ".join(f"rare{rng.random()}" if k % 2 else rng.choice(["aa", "bb", "cc"]) for k in range(300)), 9000), ("", rows[0][1], 9001)]
    df = spark.createDataFrame(rows, "lang string, text string, doc_id long").repartition(5)
    refs = fit_references(df)
    assert set(refs.languages) == {f"l{k}" for k in range(70)}
    kept = {r.doc_id: r for r in quality_rules.judge(df, refs, lang="lang").collect()}
    assert len(kept) == len(rows) and all(r.kept for r in kept.values())
    assert max(kept[d].word_distance for _, _, d in rows if d < 9000) < 0.4
    assert quality_rules.keep_good(df, refs, lang="lang").count() == len(rows)

"""The pipeline's near-duplicate stage on null ids and on ids with several texts."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import corpus_pipeline
from test_operators import SCHEMA, odd_rows


def test_one_row_of_each_group_stays(spark):
    rows = odd_rows()
    alone = " ".join(f"lone{k}" for k in range(70))
    both = " ".join(f"both{k}" for k in range(70))
    rows += [(i, t, "en", "s", 1, 1, "k", 1, 1, 1) for i, t in ((None, alone), (90, both), (90, both + " end"), (91, both), (None, both))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stage = corpus_pipeline.near_duplicates(spark, docs, "")
    assert stage.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in stage.collect())
    assert set(found.values()) == {1}
    groups, wordless = defaultdict(set), set()
    for k, n, c in brute.jaccard_components([(k, r[1]) for k, r in enumerate(rows)]):
        (groups[c] if n else wordless).add(rows[k][:2])
    for members in groups.values():
        least = min(((i is None, i or 0) for i, _ in members))
        kept = members & set(found)
        assert len(kept) == 1 and {(i is None, i or 0) for i, _ in kept} == {least}
    assert set(found) == wordless | {m for members in groups.values() for m in members if m in found}
    assert (None, alone) in found and (3, "other text under a used id") in found

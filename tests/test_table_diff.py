"""Table differences by digests of key ranges against a plain comparison."""

import random

import pytest

from biotope.operators import quality

SCHEMA = "site string, week int, a long, b double"


def plain(rebuilt, stored):
    left, right = {r[:2]: r[2:] for r in rebuilt}, {r[:2]: r[2:] for r in stored}
    out = []
    for key in set(left) | set(right):
        if key not in right or None in key and key in left:
            out.append((*key, "missing", "", None, None))
        if key not in left or None in key and key in right:
            out.append((*key, "unexpected", "", None, None))
        if key in left and key in right and None not in key:
            for name, x, y in zip("ab", left[key], right[key], strict=True):
                if x != y:
                    out.append((*key, "value", name, None if x is None else str(x), None if y is None else str(y)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [(12, 26), (1, 2)])
def test_reports_what_a_full_join_reports(spark, monkeypatch, bits):
    """Missing and unexpected keys, unequal cells, nulls that move between columns, null keys, other types; coarse and fine ranges."""
    monkeypatch.setattr(quality, "RANGE_BITS", bits)
    draw = random.Random(9)
    rows = [(f"s{k % 40}", k // 40, draw.choice([None, k]), draw.choice([None, k / 4])) for k in range(2000)]
    rows += [(None, 7, 1, 1.0), ("s1", None, 2, 2.0)]
    other = [r for r in rows if draw.random() > 0.01] + [("new", 1, 1, 1.0)]
    for k in draw.sample(range(len(other)), 25):
        site, week, a, b = other[k]
        other[k] = (site, week, draw.choice([None, a, 5]), None if a is None else float(a))
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
    found = quality.table_diff(a, b, ["site", "week"], ["a", "b"]).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows, other)
    wide = b.selectExpr("site", "cast(week as bigint) week", "a", "b")
    assert len(quality.table_diff(a, wide, ["site", "week"], ["a", "b"]).collect()) == len(found)


def test_equal_tables_join_no_rows(spark):
    """No range differs, so what is left of both tables is empty before the join."""
    df = spark.range(5000).selectExpr("id", "id * 3 as v")
    ranges = quality.differing_ranges(df, df.orderBy("v"), ["id"], ["v"], 12)
    assert ranges.count() == 0
    assert quality.within(df, ranges, ["id"], 12).count() == 0
    assert quality.table_diff(df, df, ["id"], ["v"]).collect() == []
    changed = df.selectExpr("id", "if(id = 17, -1L, v) as v")
    ranges = quality.differing_ranges(df, changed, ["id"], ["v"], 12)
    assert ranges.count() == 1 and quality.within(df, ranges, ["id"], 12).count() < 20

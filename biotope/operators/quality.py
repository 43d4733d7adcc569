"""Data-quality queries: each returns the offending rows, or numbers to compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.functions.calendar import iso_week_start
from biotope.functions.rules import all_present
from biotope.session import materialize


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def name_mismatch(left: DataFrame, right: DataFrame, code: str, name: str, sample: int = 10) -> DataFrame:
    """Number of codes whose names differ, and the first few of them (a report of ``sample`` codes)."""
    other = right.select(code, F.col(name).alias("other_name"))
    pairs = left.select(code, name).distinct().join(other.distinct(), code)
    differing = pairs.where(F.col(name) != F.col("other_name")).select(code).distinct()
    first = differing.orderBy(code).limit(sample).agg(F.array_join(F.array_sort(F.collect_list(code)), ",")).scalar()
    return differing.agg(F.count(F.lit(1)).alias("mismatches")).withColumn("sample", first)


def wrong_week_bounds(df: DataFrame, start: str, end: str, year: str, week: str) -> DataFrame:
    monday = iso_week_start(F.col(year), F.col(week))
    derived = df.withColumn("derived_start", monday).withColumn("derived_end", F.date_add(monday, 6))
    return derived.where(
        ~F.col(start).eqNullSafe(F.col("derived_start")) | ~F.col(end).eqNullSafe(F.col("derived_end"))
    )


def broken_totals(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    return df.where(F.col(total) != sum([F.col(p) for p in parts[1:]], F.col(parts[0])))


#: Bits of the key ranges whose digests are compared on the two levels of a table difference, and ranges that are sent
#: to every task.
RANGE_BITS, SENT_RANGES = (12, 26), 100_000


def key_range(keys: Sequence[str], bits: int) -> Column:
    """Range of the hash of the keys, the same for equal keys of different types."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k).cast("string") for k in keys]), 64 - bits)


def range_digests(rows: DataFrame, keys: Sequence[str], values: Sequence[str], bits: int, name: str) -> DataFrame:
    """(key_range, digest) of the rows: their number and the sum of their hashes, by partial aggregation."""
    parts = [part for c in (*keys, *values) for part in (F.col(c).isNull(), F.col(c).cast("string"))]
    digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")))
    return rows.groupBy(key_range(keys, bits).alias("key_range")).agg(digest.alias(name))


def differing_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], bits: int) -> DataFrame:
    """Key ranges whose rows are not the same on both sides, as a written table."""
    both = range_digests(a, keys, values, bits, "digest_a").join(range_digests(b, keys, values, bits, "digest_b"), "key_range", "full_outer")
    return materialize(both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("key_range"), "ranges")


def within(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Rows whose key range is among the given ones."""
    few = ranges.count() <= SENT_RANGES
    marked = rows.withColumn("key_range", key_range(keys, bits))
    return marked.join(F.broadcast(ranges) if few else ranges, "key_range", "left_semi").drop("key_range")


def table_diff(rebuilt: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per missing key, unexpected key or unequal cell.

    Both tables are first compared by digests of 4,096 key ranges, then by finer ones inside those that differ; only
    rows of fine ranges that differ are joined. Equal tables thus cost one pass each and no shuffle of rows. Rows
    with a null key match nothing and are reported as they are. Rows that repeat a key are matched each with each
    where their range differs at all.
    """
    keys, values = list(keys), list(values)
    sides = [rebuilt.select(*keys, *values), stored.select(*keys, *values)]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    known, odd = [s.where(whole) for s in sides], [s.where(~whole) for s in sides]
    for bits in RANGE_BITS:
        ranges = differing_ranges(*known, keys, values, bits)
        known = [within(s, ranges, keys, bits) for s in known]
    return _cell_differences(*[s.union(o) for s, o in zip(known, odd, strict=True)], keys, values)


def _cell_differences(rebuilt: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    a = rebuilt.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(1).alias("in_a"))
    b = stored.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(1).alias("in_b"))
    both = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected")
    row_level = F.struct(
        kind.alias("mismatch"),
        F.lit("").alias("column_name"),
        F.lit(None).cast("string").alias("rebuilt_value"),
        F.lit(None).cast("string").alias("stored_value"),
    )
    cells = [
        F.when(
            F.col("in_a").isNotNull()
            & F.col("in_b").isNotNull()
            & ~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")),
            F.struct(
                F.lit("value").alias("mismatch"),
                F.lit(v).alias("column_name"),
                F.col(f"{v}_a").cast("string").alias("rebuilt_value"),
                F.col(f"{v}_b").cast("string").alias("stored_value"),
            ),
        )
        for v in values
    ]
    found = F.filter(F.array(F.when(kind.isNotNull(), row_level), *cells), lambda c: c.isNotNull())
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def missing_after_join(df: DataFrame, code: str, features: Sequence[str]) -> DataFrame:
    return df.where(~all_present([F.col(f) for f in features])).groupBy(code).agg(
        F.count(F.lit(1)).alias("rows_missing")
    )


def conflicting_mapping(df: DataFrame, key: str, mapped: str) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count_distinct(mapped).alias("mapped_count"), F.min(mapped).alias("first_mapped"), F.max(mapped).alias("last_mapped"))
        .where("mapped_count > 1")
    )


def expected_cardinality(df: DataFrame, groups: Sequence[str], member: str, expected: int | Column) -> DataFrame:
    counted = df.groupBy(*groups).agg(F.count_distinct(member).alias("members"))
    return counted.withColumn("expected", F.lit(expected) if isinstance(expected, int) else expected).withColumn(
        "as_expected", F.col("members") == F.col("expected")
    )


def period_sequence(df: DataFrame, site: str, period: str, reference: Column, least: int = 6) -> DataFrame:
    """Sites whose period count and last period make the current and previous period usable."""
    seen = df.groupBy(site).agg(F.count_distinct(period).alias("periods"), F.max(period).alias("last_period"))
    return seen.withColumn("usable", (F.col("periods") >= least) & (F.col("last_period") == reference))

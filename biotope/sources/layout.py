"""Tables written along a space-filling curve, so that file statistics prune several columns at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.operators.ordering import with_bucket

#: Bits of each column's place on the curve; ranks are cut at so many even quantiles.
CURVE_BITS = 8


def interleaved(places: Sequence[Column], bits: int = CURVE_BITS) -> Column:
    """Curve position (a long): the bits of the places in turn, highest first."""
    parts = [
        F.shiftleft(F.shiftright(p.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(places) + len(places) - 1 - k)
        for k, p in enumerate(places)
        for b in range(bits)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def with_curve(df: DataFrame, columns: Sequence[str], name: str = "curve", bits: int = CURVE_BITS) -> DataFrame:
    """``df`` with its position on the curve through ``columns`` (numbers, dates or timestamps).

    A column's place is its rank among even quantiles of all rows, found in one aggregate, so that uneven values fill
    the curve evenly; a row with a missing value has the place after all others.
    """
    kinds = dict(df.dtypes)
    number = {c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double") for c in columns}
    ranks = [(k + 1) / (1 << bits) for k in range((1 << bits) - 1)]
    cuts = df.agg(*[F.percentile_approx(number[c], ranks, 10_000).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    out = df.withColumns({f"__{k}": number[c] for k, c in enumerate(columns)})
    last, places = (1 << bits) - 1, []
    for k in range(len(columns)):
        own = sorted(set(cuts[f"c{k}"] or []))
        out = with_bucket(out, f"__{k}", own, f"__place_{k}")
        # few different values spread over all bits; NaN comes after the last cut
        spread = F.floor(F.col(f"__place_{k}") * float(1 << bits) / (len(own) + 1))
        places.append(F.coalesce(F.least(spread, F.lit(last)), F.lit(last)))
    return out.withColumn(name, interleaved(places, bits)).drop(*[f"__{k}" for k in range(len(columns))], *[f"__place_{k}" for k in range(len(columns))])


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int) -> None:
    """Parquet in about ``files`` files, each a stretch of the curve through ``columns`` and sorted along it.

    A scan of a range in any of the columns, or a box in several, opens the files whose statistics meet it.
    """
    placed = with_curve(df, columns, "__curve")
    spark, kind = df.sparkSession, "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(kind)
    spark.conf.set(kind, "TIMESTAMP_MICROS")  # the older form has no statistics
    try:
        placed.repartitionByRange(files, "__curve", *columns).sortWithinPartitions("__curve", *columns).drop("__curve").write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(kind, before)

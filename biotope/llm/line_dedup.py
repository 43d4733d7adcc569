"""Cross-site boilerplate lines: lines that many distinct sites share, by HyperLogLog sketches.

Texts are cut into lines once, into a written table of (row, position, MD5 of the line) that every later step reads.
A line found fewer times than the threshold is on fewer sites as well, so most lines end at a plain count. Of the others,
sketches of the sites are built per line with partial aggregation and merged; a line whose estimate is clearly below
the threshold is kept, clearly above it is boilerplate, and in between the distinct sites are counted exactly. Lines go
by their positions. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.session import materialize

#: log2 of the sketch's registers: a relative standard error of about 1.6 %.
SKETCH = 12
#: An estimate within this share of the threshold is counted exactly: over ten standard errors, and
#: never less than one site, so that lines on both sides of the threshold are counted.
BAND = 0.2
#: Line keys (24 bytes each) that are sent to every task; salts of a line where there are more.
SENT_KEYS, SALTS = 200_000, 64


def line_array(text: Column) -> Column:
    """Lines of a text, split at the line feed; a null text has none."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def has_word(line: Column) -> Column:
    """Whether the line holds anything but white space."""
    return F.ltrim(line, F.lit(" \t\n\u000b\f\r")) != ""


def _lines(docs: DataFrame, id_column: str, text: str, site: str) -> DataFrame:
    """(_id, _text, _site, _at, line_key) of every line with a word, written once; ``_text`` is a hash of the whole text."""
    rows = docs.select(
        F.col(id_column).alias("_id"), F.xxhash64(text).alias("_text"), F.col(site).alias("_site"), F.posexplode(line_array(F.col(text))).alias("_at", "_line")
    )
    return materialize(rows.where(has_word(F.col("_line"))).select("_id", "_text", "_site", "_at", line_key(F.col("_line")).alias("line_key")), "lines")


def _with_keys(lines: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join with a written table of one row per line key. Up to ``SENT_KEYS`` rows it is sent to all tasks; a larger one
    meets the lines by key and a salt, so that no line is a task of its own."""
    if keys.count() <= SENT_KEYS:
        return lines.join(F.broadcast(keys), "line_key", how)
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_at"), F.lit(SALTS)))
    return salted.join(keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["line_key", "_salt"], how).drop("_salt")


def _spread(lines: DataFrame, min_sites: int) -> DataFrame:
    often = lines.groupBy("line_key").agg(F.count("*").alias("_n"), F.min("_id").alias("first_id")).where(F.col("_n") >= min_sites)
    often = materialize(often.select("line_key", "first_id"), "frequent_lines")
    shared = _with_keys(lines, often.select("line_key"), "left_semi")
    rated = shared.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(SKETCH))).alias("_sites"))
    width = max(1.0, BAND * min_sites)
    rated = materialize(rated.where(F.col("_sites") >= min_sites - width), "rated_lines")
    sure = rated.where(F.col("_sites") > min_sites + width).select("line_key")
    near = rated.where(F.col("_sites") <= min_sites + width).select("line_key")
    exact = (
        _with_keys(lines.where("_site is not null"), near, "left_semi")
        .select("line_key", "_site").distinct().groupBy("line_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_sites)
    )
    return materialize(often.join(sure.union(exact.select("line_key")), "line_key"), "spread_lines")


def spread_lines(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(line_key, first_id) of lines found on at least ``min_sites`` distinct sites, and the smallest id that has each.

    Rows without a site add none. Sketches merge map-side, so a line that a third of all texts hold
    is a row per task; the exact count of near-threshold lines first makes (line, site) pairs distinct.
    """
    return _spread(_lines(docs, id_column, text, site), min_sites)


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` without boilerplate lines, plus ``n_lines`` and ``n_removed`` (lines that hold a word).

    A boilerplate line stays in the text with the smallest id that has it, and goes everywhere else.
    Texts without one are as they were, byte for byte; null texts stay null, rows are never dropped.
    Rows with a null id or without any line to lose are kept as they are. Rows that repeat an id with
    another text are judged each by its own lines. Columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    lines = _lines(docs, id_column, text, site)
    bad = (
        _with_keys(lines, _spread(lines, min_sites), "inner").where(F.col("_id") > F.col("first_id"))
        .groupBy(F.col("_id").alias("_bad_id"), F.col("_text").alias("_bad_text")).agg(F.collect_set("_at").alias("_bad"))
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    packed = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_text"), F.struct(*rest).alias("_row"))
    joined = packed.join(bad, (F.col("_id") == F.col("_bad_id")) & (F.col("_text") == F.col("_bad_text")), "left").select("_row", "_bad")
    cut = joined.select("_row", "_bad", line_array(F.col("_row")[text]).alias("_lines"))
    counted = cut.select("*", F.size(F.filter("_lines", has_word)).cast("long").alias("n_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_bad"))
    kept = F.array_join(F.transform(left, lambda k: F.get("_lines", k)), "\n")
    none = F.col("_bad").isNull()
    return counted.select(
        *[F.when(none, F.col("_row")[c]).otherwise(kept).alias(c) if c == text else F.col("_row")[c].alias(c) for c in rest],
        "n_lines",
        F.when(none, F.lit(0)).otherwise(F.size("_bad")).cast("long").alias("n_removed"),
    )

"""Bounded samples of labelled rows to fit models on, and the folds they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled ids, chosen by a hash of the id.

    Ids are chosen from the narrow table of labels, so that only the chosen texts move. Null labels
    and texts are left out; of several labels of an id the largest counts, of several texts the one of least hash.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    source = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    held = source.join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows are sent
    return held.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def class_counts(labels: DataFrame, label: str) -> dict:
    """Labelled rows of each value of the label; labels have a handful of values."""
    return {r[0]: r[1] for r in labels.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def collected(sample: DataFrame) -> tuple[list, list]:
    """Texts and labels of a sample in the order of the ids, on the driver."""
    rows = sorted(sample.select("doc_id", "text", "label").collect(), key=lambda r: (r[0], r[1]))
    return [r[1] for r in rows], [r[2] for r in rows]

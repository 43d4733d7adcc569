"""From raw documents to token digests: quality rules, line dedup, Jaccard join, decontamination, tokens.

Each stage reads what the stage before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.llm import bpe
from biotope.llm.decontaminate import without_matches
from biotope.llm.jaccard_join import jaccard_classes
from biotope.llm.line_dedup import remove_spread_lines
from biotope.llm.quality_rules import fit_references, keep_good
from biotope.session import materialize, prepare

#: Distinct sources from which on a line is boilerplate.
MIN_SITES = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a reference language; null and short texts go."""
    return keep_good(docs, fit_references(docs), lang="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines removed; a document of which no line is left goes, its text is elsewhere."""
    left = remove_spread_lines(docs, MIN_SITES).where("n_removed = 0 or n_removed < n_lines")
    return left.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.75, the one with the smallest id.

    A document without an id comes last and stays where its group has no other; of several texts under the
    smallest id one stays. Texts without words are linked with nothing and stay. Rows of equal id and text,
    null ids included, are one document.
    """
    keyed = docs.select("doc_id", "text", F.md5("text").alias("text_key"))
    rows = materialize(jaccard_classes(keyed, carry=["text_key"]), "classes")
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "set_key", "text_key")).alias("kept")
    named = [F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_key").alias("kept_key")]
    first = rows.where("root is not null").groupBy("root").agg(kept).select(*named)
    keep = first.union(rows.where("root is null").select("doc_id", "text_key"))
    same = docs["doc_id"].eqNullSafe(keep["kept_id"]) & F.md5(docs["text"]).eqNullSafe(keep["kept_key"])
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, with up to 5 % of its characters edited."""
    return without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_pair_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of each document's token ids and of the bytes they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", byte_pair_tokens),
]

#: Edit distance, Jaccard components and BPE merges are beyond DuckDB's SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The operators of this package bound to the test tables, each whole table through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.llm import bpe, language_kernel, quality_classifier, toxicity_crf
from biotope.llm.blocked_search import ranked_search
from biotope.llm.conversation_repair import damage, repair_summary
from biotope.llm.decontaminate import benchmark_matches
from biotope.llm.jaccard_join import jaccard_components
from biotope.llm.line_dedup import remove_spread_lines
from biotope.llm.pivot_index import near_copies
from biotope.llm.quality_rules import fit_references, judge
from biotope.llm.sampling import fold
from biotope.llm.sharding import shard_documents
from biotope.llm.suffix_dedup import dedup_windows

#: A line on so many distinct sources is boilerplate.
MIN_SITES = 10


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return judge(docs, fit_references(docs), lang="lang")


def _held_out(folds: int, held: int):
    return fold("doc_id", folds) == held


def op2_string_kernel_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    known = docs.where(~_held_out(3, 1)).select("doc_id", "lang")
    found = language_kernel.predict(docs, language_kernel.fit(docs.select("doc_id", "text"), known))
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op3_toxicity_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    known = spark.read.parquet(f"{folder}/labels.parquet").where(~_held_out(4, 2))
    found = toxicity_crf.score(docs, toxicity_crf.fit(docs, known))
    return found.select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_toxic_words",
        F.transform("spans", lambda s: s["start"]).alias("span_starts"), F.transform("spans", lambda s: s["end"]).alias("span_ends"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_spread_lines(documents(spark, folder), MIN_SITES)
    return kept.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.md5("text").alias("kept_md5"))


ORACLE_4 = f"""
with lines as (
  select doc_id, source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')))) as line
  from documents),
spread as (select line, min(doc_id) as first_id from lines group by line having count(distinct source) >= {MIN_SITES}),
bad as (select l.doc_id, list(l.line) as bad from lines l join spread s on l.line = s.line and l.doc_id > s.first_id group by l.doc_id),
kept as (
  select d.doc_id, string_split(d.text, chr(10)) as old,
         list_filter(string_split(d.text, chr(10)), lambda x: not list_contains(coalesce(b.bad, []), x)) as new
  from documents d left join bad b on d.doc_id = b.doc_id)
select doc_id,
       len(list_filter(old, lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) as n_lines,
       len(list_filter(old, lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) - len(list_filter(new, lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) as n_removed,
       cast(strlen(array_to_string(new, chr(10))) as bigint) as kept_bytes,
       md5(array_to_string(new, chr(10))) as kept_md5
from kept
"""


def op5_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(documents(spark, folder))


def op6_depth_limited_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    left = dedup_windows(documents(spark, folder))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def op7_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matches(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op8_hashed_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    known = spark.read.parquet(f"{folder}/labels.parquet").where(~_held_out(5, 0))
    found = quality_classifier.score(docs, quality_classifier.fit(docs, known))
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder))


ORACLE_9 = """
with recursive
w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
s as (
  select doc_id, unnest(list_distinct(
    case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
         when len(words) > 0 then [array_to_string(words, ' ')] else [] end)) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select p.a, p.b from (
    select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * shared >= 75 * (na.n + nb.n - shared)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n on n.doc_id = d.doc_id join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id
"""


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_pivot_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op12_lightest_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair_summary(conversations, damage(conversations))


def op13_blocked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


ORACLE_13 = """
with
q as (
  select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark)
  group by item_id, term),
d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents),
lengths as (select doc_id, len(terms) as n from d where len(terms) > 0),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as length from lengths),
held as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from d) where term in (select term from q) group by doc_id, term),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from held, corpus group by term),
scored as (
  select q.item_id, h.doc_id, cast(sum(q.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * l.n * c.docs) // c.length)))) as bigint) as score
  from q join held h on h.term = q.term join weights w on w.term = q.term join lengths l on l.doc_id = h.doc_id, corpus c
  group by q.item_id, h.doc_id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_distribution_divergence, op2_string_kernel_language, op3_toxicity_crf, op4_line_dedup, op5_jump_sharding,
        op6_depth_limited_suffixes, op7_pigeonhole_decontamination, op8_hashed_ftrl_quality, op9_ngram_jaccard_join, op10_byte_bpe, op11_pivot_permutation, op12_lightest_repair,
        op13_blocked_search,
    )
}

ORACLES: dict[str, str] = {"op4_line_dedup": ORACLE_4, "op9_ngram_jaccard_join": ORACLE_9, "op13_blocked_search": ORACLE_13}

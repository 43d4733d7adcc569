"""Quality rules by distribution divergence.

A text's histogram of character classes and its histogram of common words are compared with those of
reference languages by Jensen-Shannon distance. References are counted over all rows of the corpus that
name a language; a text is measured against the closest of them, so a wrong language tag rejects nothing. A text
tagged with a language of too few words for a reference passes the distances.
Histograms of too few counts say little and reject nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.session import materialize

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "letter_beyond")
U = np.uint64


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 count as nothing (8)."""
    table = np.full(256, 6, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[32, 9, 10, 11, 12, 13]] = 3
    table[list(b".,;:!?'\"-()")] = 4
    table[list(SYMBOLS)] = 5
    table[0x80:0xC0] = 8
    table[0xC0:] = 7
    return table


CLASS_OF = _class_table()


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Distances are square roots of base-2 divergences, from 0 to 1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.28
    max_word_distance: float = 0.46
    #: Short texts stray further by chance: each limit grows by its slack over the root of the histogram's count.
    class_slack: float = 0.6
    word_slack: float = 0.8
    #: Least characters for the class histogram, least words for the common-word histogram.
    min_chars: int = 200
    min_histogram_words: int = 60
    #: Common words kept of each language.
    common_words: int = 64
    #: Words of a language from which on its texts give a reference.
    min_reference_words: int = 1000


def _counts(column: pa.Array):
    """Per piece: rows, class counts, word hashes (lower case), text index of each word, raw bytes and spans."""
    for first, last, raw, offsets in texts.pieces(column):
        rows = last - first
        row_of = np.repeat(np.arange(rows), np.diff(offsets))
        classes = np.bincount(row_of * 9 + CLASS_OF[raw], minlength=rows * 9).reshape(rows, 9)[:, :8]
        starts, ends, doc = texts.word_spans(raw, offsets)
        yield first, last, raw, offsets, classes, starts, ends, doc


COUNTED = "lang string, kind int, item long, n long"
#: kinds of counted rows
CHARACTERS, WORD, WORDS = 0, 1, 2


def _language_counts(batches):
    """Rows (lang, kind, item, n) of each piece, by language: character classes, each word, all words."""
    kinds = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        tags = batch.column(0).dictionary_encode()
        own, names = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64), tags.dictionary
        for first, last, raw, _, classes, starts, ends, doc in _counts(batch.column(1)):
            hashes = texts.hash_spans(texts.lowered(raw), starts, ends)
            here = own[first:last]
            spoken = here[doc]
            order = np.lexsort((hashes, spoken))
            word, by = hashes[order], spoken[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (by[1:] != by[:-1])
            at = np.flatnonzero(new)
            present = np.unique(here)
            place = np.searchsorted(present, here)
            sums = np.zeros((len(present), 8), np.int64)
            np.add.at(sums, place, classes)
            lang = [by[at], np.repeat(present, 8), present]
            kind = [np.full(len(at), WORD), np.full(sums.size, CHARACTERS), np.full(len(present), WORDS)]
            item = [word[at].view(np.int64), np.tile(np.arange(8), len(present)), np.zeros(len(present), np.int64)]
            n = [np.diff(np.append(at, len(word))), sums.ravel(), np.bincount(place[doc], minlength=len(present))]
            columns = [np.concatenate(x) for x in (lang, kind, item, n)]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(columns[0]))] + [pa.array(x.astype(t)) for x, t in zip(columns[1:], (np.int32, np.int64, np.int64), strict=True)], schema=kinds
            )


@dataclass
class Shares:
    """Shares by word, without the zeros: of word k the ``language`` and ``share`` from ``at[k]`` to ``at[k + 1]``."""

    at: np.ndarray
    language: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, word: np.ndarray, language: np.ndarray, share: np.ndarray, n_words: int) -> Shares:
        order = np.lexsort((language, word))
        at = np.searchsorted(word[order], np.arange(n_words + 1))
        return cls(at, language[order].astype(np.int32), share[order])


@dataclass
class References:
    """Histograms by language: shares of character classes, and of each common word plus all others."""

    languages: list[str]
    classes: np.ndarray
    words: np.ndarray  # common words of all languages as sorted hashes
    shares: Shares | np.ndarray  # languages x (words + 1)

    def __post_init__(self) -> None:
        if isinstance(self.shares, np.ndarray):
            language, word = np.nonzero(self.shares)
            self.shares = Shares.of(word, language, self.shares[language, word], self.shares.shape[1])


def fit_references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> References:
    """References of every language with enough words, counted over all its rows.

    Only each language's common words and their counts come to the driver; tags with a few words, however
    many there are, end in Spark.
    """
    spark = docs.sparkSession
    texts.settings(spark)
    source = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = materialize(source.mapInArrow(_language_counts, COUNTED).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "words")
    totals = {r.lang: r.n for r in counted.where((F.col("kind") == WORDS) & (F.col("n") >= rules.min_reference_words)).collect()}
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    counted = counted.where(F.col("lang").isin(languages))  # no join, which would gather a language's words in one task
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "item"))
    top = counted.where(F.col("kind") == WORD).withColumn("rank", rank).where(F.col("rank") <= rules.common_words).select("item").distinct()
    top = materialize(top, "common")
    column = lambda table, name: table.column(name).to_numpy()
    words = np.sort(column(top.toArrow(), "item").astype(np.int64).view(U))
    common = counted.where(F.col("kind") == WORD).join(top, "item").select("lang", "item", "n").toArrow()
    place = {name: k for k, name in enumerate(languages)}
    total = np.array([totals[x] for x in languages], np.float64)
    classes = np.zeros((len(languages), 8))
    for r in counted.where(F.col("kind") == CHARACTERS).collect():
        classes[place[r.lang], r.item] = r.n
    tags = common.column("lang").combine_chunks().dictionary_encode()
    if isinstance(tags, pa.ChunkedArray):
        tags = tags.combine_chunks()
    number = np.array([place[x] for x in tags.dictionary.to_pylist()], np.int64)
    language = number[tags.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
    n = column(common, "n").astype(np.float64)
    others = total - np.bincount(language, weights=n, minlength=len(languages))
    word = np.searchsorted(words, column(common, "item").astype(np.int64).view(U))
    word = np.concatenate([word, np.full(len(languages), len(words))])
    language, n = np.concatenate([language, np.arange(len(languages))]), np.concatenate([n, others])
    held = n > 0
    shares = Shares.of(word[held], language[held], n[held] / total[language[held]], len(words) + 1)
    return References(languages, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), words, shares)


#: Pairs of a text's word and a reference that has it, held at a time.
PAIRS = 1 << 20


def word_distances(row: np.ndarray, word: np.ndarray, count: np.ndarray, rows: int, languages: int, shares: Shares) -> np.ndarray:
    """As ``distances``, of histograms given by ascending (row, word, count).

    A word that only one of two histograms has adds half its share to their divergence, so that is one less
    what the words of both take off.
    """
    total = np.bincount(row, weights=count, minlength=rows)
    best = np.zeros(rows)
    if not languages:
        return best
    bounds = np.searchsorted(row, np.arange(rows + 1))
    width = np.concatenate([[0], np.cumsum(shares.at[word + 1] - shares.at[word])])
    weight = width[bounds] + languages * np.arange(rows + 1)
    plogp = lambda x: x * np.log2(x)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(weight, weight[first] + PAIRS, "right")) - 1)
        part = slice(bounds[first], bounds[last])
        begin = shares.at[word[part]]
        n = shares.at[word[part] + 1] - begin
        entry = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        p = np.repeat(count[part] / total[row[part]], n)
        q = shares.share[entry]
        both = plogp((p + q) / 2) - (plogp(p) + plogp(q)) / 2 + (p + q) / 2
        pair = np.repeat(row[part] - first, n) * languages + shares.language[entry]
        taken = np.bincount(pair, weights=both, minlength=(last - first) * languages).reshape(last - first, languages)
        best[first:last] = 1 - taken.max(axis=1)
        first = last
    return np.where(total > 0, np.sqrt(np.clip(best, 0, 1)), 0.0)


def distances(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Least Jensen-Shannon distance of each row of counts to any reference, base 2; 0 without references or counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    best = np.full(len(p), np.inf)
    plogp = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0)
    own = plogp(p).sum(axis=1)
    for q in references:
        middle = plogp((p + q) / 2).sum(axis=1)
        best = np.minimum(best, (own + plogp(q).sum()) / 2 - middle)
    return np.where((total[:, 0] > 0) & np.isfinite(best), np.sqrt(np.clip(best, 0, 1)), 0.0)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Per text: words that lie in a 3-word window found twice or more in the text."""
    out = np.zeros(rows, np.int64)
    grams, owner = texts.hash_grams(hashes, doc, 3)
    if not len(grams):
        return out
    place = np.flatnonzero(doc[:-2] == doc[2:])
    _, inverse, times = np.unique(texts.mix(grams ^ (owner.astype(U) + U(1)) * texts.LENGTH), return_inverse=True, return_counts=True)
    again = place[times[inverse] > 1]
    hit = np.zeros(len(hashes), bool)
    for k in range(3):
        hit[again + k] = True
    np.add.at(out, doc[hit], 1)
    return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(lines) - len(set(lines))


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "class_distance double, word_distance double, kept boolean"
)


def judge(
    docs: DataFrame, references: References, rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text", carry: list[str] | None = None,
    lang: str | None = None,
) -> DataFrame:
    """(doc_id, base figures, distances, kept) of each row's whole text, or the ``carry`` columns in place of the id.

    A null text has no words, fails the base rules and is not kept. Repeated rows give repeated
    results; extra columns are ignored; an empty table gives an empty table. Without references, and for a
    text whose language ``lang`` names but has none, only the base rules decide.
    """
    texts.settings(docs.sparkSession)
    ref = docs.sparkSession.sparkContext.broadcast(references)
    source = docs.select(*[F.col(c) for c in carry or []], *([] if carry else [F.col(id_column).alias("doc_id")]), F.lit(None).cast("string").alias("_lang") if lang is None else F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    result = source.drop("_lang", "_text").withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in RESULT.split(", ")}).schema
    names, last_one = result.names, len(source.columns) - 2
    rated = pa.array(["", *references.languages])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches):
        refs = ref.value
        for batch in batches:
            bodies = batch.column(last_one + 1).to_pylist()
            tags = batch.column(last_one)
            foreign = pc.and_(tags.is_valid(), pc.invert(pc.is_in(tags, value_set=rated))).to_numpy(zero_copy_only=False)
            for first, last, raw, offsets, classes, starts, ends, doc in _counts(batch.column(last_one + 1)):
                rows = last - first
                hashes = texts.hash_spans(raw, starts, ends)
                n_words = np.bincount(doc, minlength=rows)
                # bytes that begin a code point, by word
                begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                chars = np.bincount(doc, weights=begins[ends] - begins[starts], minlength=rows).astype(np.int64)
                signs = np.concatenate([[0], np.cumsum(symbol[raw])])[offsets]
                repeat = repeated_words(hashes, doc, rows)
                dup = np.array([repeated_lines(t) if t else 0 for t in bodies[first:last]], np.int64)
                failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
                by_class = distances(classes, refs.classes)
                k = np.full(len(hashes), len(refs.words))
                if len(refs.words) and len(hashes):
                    folded = texts.hash_spans(texts.lowered(raw), starts, ends)
                    near = np.minimum(np.searchsorted(refs.words, folded), len(refs.words) - 1)
                    k = np.where(refs.words[near] == folded, near, k)
                pair, times = np.unique(doc * (len(refs.words) + 1) + k, return_counts=True)
                by_word = word_distances(*np.divmod(pair, len(refs.words) + 1), times, rows, len(refs.languages), refs.shares)
                chars_seen = classes.sum(axis=1)
                class_limit = rules.max_class_distance + rules.class_slack / np.sqrt(np.maximum(chars_seen, 1))
                word_limit = rules.max_word_distance + rules.word_slack / np.sqrt(np.maximum(n_words, 1))
                odd = (by_class > class_limit) & (chars_seen >= rules.min_chars)
                odd |= (by_word > word_limit) & (n_words >= rules.min_histogram_words)
                figures = [n_words, chars, np.diff(signs), dup, repeat]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, rows) for k in range(last_one)]
                    + [pa.array(x.astype(np.int64)) for x in figures]
                    + [pa.array(failed), pa.array(by_class), pa.array(by_word), pa.array(~failed & (~odd | foreign[first:last]))],
                    names,
                )

    return source.mapInArrow(run, result)


def keep_good(docs: DataFrame, references: References, rules: Rules = Rules(), text: str = "text", lang: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose text the rules keep, with all their columns, whatever these are called."""
    tag = F.lit(None).cast("string") if lang is None else F.col(lang)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), tag.alias("_tag"), F.col(text).alias("_body"))
    return judge(rows, references, rules, text="_body", carry=["_row"], lang="_tag").where("kept").select("_row.*")

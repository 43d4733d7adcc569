"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e edits is cut into e + 1 pieces: a passage within e edits of it holds
at least one piece unchanged. All pieces are searched at once with an Aho-Corasick automaton; the hits
of an item that lie on neighbouring diagonals make one window of the text, which is verified with
Myers' bit-parallel edit distance (the item's positions are the bits of one integer, so an item of any
length takes one step a character). Text and items are compared in lower case with runs of white space
as one space. Items too short to bear edits are found by the same automaton, exactly and between word bounds.

Items are dealt into blocks of bounded size by a hash; each block is read, searched for in all texts, and its matches
written, before the next one is read.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.session import materialize

#: Edits allowed per character of an item.
ERROR_RATE = 0.05
#: Shorter items (after normalising) must stand in the text as they are, as whole words.
MIN_CHARS = 32
#: Characters of items that one automaton holds, about; a larger benchmark is searched in so many blocks.
BLOCK_CHARS = 2_000_000


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def error_pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of the ``budget + 1`` pieces, of lengths that differ by one at most."""
    parts = budget + 1
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, window: str, budget: int) -> tuple[int, int] | None:
    """(least distance, end) of the item against any substring of the window, or None above the budget."""
    m = len(item)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = budget + 1, 0
    for j, c in enumerate(window):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if best <= budget else None


class Matcher:
    """Items (id, normalised text) ready to be searched for in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, self.min_chars = items, min_chars
        self.budgets = [int(len(text) * rate) if len(text) >= min_chars else 0 for _, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for offset, piece in error_pieces(text, self.budgets[k]):
                places[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def windows(self, text: str):
        """(item, start, end) of the stretches of the text that hold a piece of the item in about its place."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                diagonals[k].add(end + 1 - size - offset)
        for k, found in diagonals.items():
            slack, size = self.budgets[k], len(self.items[k][1])
            if size < self.min_chars:
                whole = (d for d in found if text[d - 1 : d] in ("", " ") and text[d + size : d + size + 1] in ("", " "))
                yield from ((k, d, d + size) for d in sorted(whole)[:1])
                continue
            low = high = None
            for d in sorted(found):
                if low is None or d > high + 2 * slack + 1:
                    if low is not None:
                        yield k, max(0, low - slack), high + size + slack
                    low = d
                high = d
            yield k, max(0, low - slack), high + size + slack

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """item id -> (least distance, end in the normalised text, item characters) of the items found."""
        out: dict[int, tuple[int, int, int]] = {}
        for k, start, end in self.windows(text) if len(self.automaton) else ():
            name, item = self.items[k]
            if name in out and out[name][0] == 0:
                continue
            window = text[start:end]
            at = window.find(item)
            found = (0, at + len(item)) if at >= 0 else myers(item, window, self.budgets[k])
            if found and (name not in out or found[0] < out[name][0]):
                out[name] = (found[0], start + found[1], len(item))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark's items as (id, normalised text), one block of about ``BLOCK_CHARS`` after another; items that share an id share a block."""
    items = benchmark.select(F.col(item_id).alias("name"), F.col(text).alias("body")).where(F.col("name").isNotNull() & F.col("body").isNotNull())
    blocks = -(-(items.agg(F.sum(F.char_length("body"))).first()[0] or 0) // BLOCK_CHARS)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).distinct().collect()  # a block of the benchmark
        yield [(name, item) for name, body in mine if (item := normalized(body))]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, end) for each row of ``docs`` and item that it holds.

    distance is the least number of edits, end the place after the passage in the normalised text.
    Whole texts are searched; null and empty texts hold nothing, null and blank items are nowhere. Items under
    ``min_chars`` must stand there without an edit, between white space or the text's ends. Repeated rows give repeated
    matches; of items that share an id the nearest counts. Extra columns are ignored. Without rows or items the result is empty.
    """
    spark = docs.sparkSession
    texts.settings(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, item_chars int, end long"
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def search(block):
        items = spark.sparkContext.broadcast(block)

        def run(batches):
            matcher = Matcher(items.value, rate, min_chars)
            for batch in batches:
                rows, cells = [], []
                for r, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        for name, (distance, end, size) in matcher.matches(normalized(t)).items():
                            rows.append(r)
                            cells.append((name, distance, size, end))
                if rows:
                    name, distance, size, end = zip(*cells, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(name), pa.array(distance, pa.int32()), pa.array(size, pa.int32()), pa.array(end, pa.int64())],
                        ["doc_id", "item_id", "distance", "item_chars", "end"],
                    )

        return source.mapInArrow(run, schema)

    found = [materialize(search(block), "matches") for block in item_blocks(benchmark, item_id, item_text) if block]
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.union, found)


def without_matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item. All columns stay; a row whose id is null is kept.

    Rows that share an id share a verdict.
    """
    hit = benchmark_matches(docs, benchmark, id_column, text, **options).select(F.col("doc_id").alias("_hit")).distinct()
    packed = docs.select(F.col(id_column).alias("_id"), F.struct(*docs.columns).alias("_row"))
    return packed.join(hit, F.col("_id") == F.col("_hit"), "left_anti").select("_row.*")

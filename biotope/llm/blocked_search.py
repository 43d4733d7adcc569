"""Ranked lexical search by per-term geometric blocking.

1. The texts become vectors over the terms that the queries hold (the forward index), with document frequencies and
   lengths counted over all texts. A term's coordinate is its weight times its saturated frequency, an integer.
2. Documents are dealt by similarity: the nearest two of a bounded sample of documents order them, so that a range of
   the order (a shard) holds documents alike. Any number of equal documents spreads over as many shards.
3. Within a shard each term's posting list, in that order, is cut into blocks of ``BLOCK`` documents. A block stores
   the coordinatewise maximum of its documents, for the terms that a query can ask for there: terms rank rarest first,
   and as a document is reached by the list of its rarest term of a query, a block only needs its own term and
   commoner ones that some query holds together with it.
4. A query sums its weights over a block's maxima: no document that it reaches through that block first can score
   higher. Every shard first opens the few blocks of the highest bounds; the best scores of all shards give a
   query's threshold. Then all blocks are opened but those whose bound lies below it, and every document in them is
   scored from the forward index. So the result is exact.

Terms are compared by 64-bit hashes. Queries are taken in blocks of about ``ITEM_BYTES``; one such block, its
vocabulary and its thresholds are what meets on the driver and travels to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.session import materialize

TOP = 20
#: Documents of a block of a posting list, and blocks that a shard opens for a first threshold.
BLOCK, FIRST_BLOCKS = 64, 4
#: Documents of a shard, and cells of its table of documents by terms; bytes of the sample that orders documents.
SHARD_DOCS, SHARD_CELLS, CENTRES, CENTRE_BYTES = 2048, 1 << 23, 64, 32 << 20
#: Bytes of query text that are searched for at a time.
ITEM_BYTES = 1 << 20
#: Pairs of terms held by one query, up to which blocks store only these; beyond, all commoner terms.
TERM_PAIRS = 1 << 22
#: Rows of the index (some megabytes each) in one batch.
SHARDS_PER_BATCH = 2

#: ASCII characters that do not belong to a term.
NO_TERM = np.zeros(256, bool)
NO_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def hashed_terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, term hashes, row of each within the piece) of consecutive texts; A-Z count as a-z."""
    for first, last, raw, offsets in texts.pieces(column):
        other = NO_TERM[raw]
        filled = offsets[1:] > offsets[:-1]
        before, after = np.ones_like(other), np.ones_like(other)
        before[1:], after[:-1] = other[:-1], other[1:]
        before[offsets[:-1][filled]] = True
        after[offsets[1:][filled] - 1] = True
        starts, ends = np.flatnonzero(~other & before), np.flatnonzero(~other & after) + 1
        owner = np.searchsorted(offsets, starts, "right") - 1
        yield first, last, texts.hash_spans(texts.lowered(raw), starts, ends), owner


class Queries(NamedTuple):
    """A block of items over its vocabulary. Terms are numbered rarest first once their weights are known."""

    items: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


class Corpus(NamedTuple):
    """Counts over all texts, and weights of the vocabulary in the order of its numbers."""

    documents: int
    length: int
    weights: np.ndarray


def read_queries(numbers: list[int], bodies: list[str | None]) -> tuple[np.ndarray, Queries]:
    """Sorted hashes of the vocabulary, and the items by places in it."""
    parts = [(h, owner + first) for first, _, h, owner in hashed_terms(pa.array(bodies, pa.string()))]
    hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    owner = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    vocabulary, place = np.unique(hashes, return_inverse=True)
    code, counts = np.unique(owner * max(1, len(vocabulary)) + place, return_counts=True)
    owner, place = np.divmod(code, max(1, len(vocabulary)))
    return vocabulary, Queries(np.array(numbers, np.int64), np.searchsorted(owner, np.arange(len(numbers) + 1)), place, counts)


def ranked(queries: Queries, frequencies: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, Queries]:
    """(number of each vocabulary place, weights by number, items by number); terms that no text holds have number -1."""
    # in doubles, as the contract of the weight says
    weights = np.array([int(np.floor(1000 * np.log((2 * documents + 2) / (2 * f + 1)))) if f else 0 for f in frequencies.tolist()], np.int64)
    order = np.argsort(np.where(frequencies > 0, frequencies, documents + 1), kind="stable")[: int((frequencies > 0).sum())]
    number = np.full(len(frequencies), -1, np.int64)
    number[order] = np.arange(len(order))
    terms = number[queries.terms]
    owner = np.repeat(np.arange(len(queries.items)), np.diff(queries.bounds))
    keep = np.lexsort((terms, owner))
    keep = keep[terms[keep] >= 0]
    kept = Queries(queries.items, np.searchsorted(owner[keep], np.arange(len(queries.items) + 1)), terms[keep], queries.counts[keep])
    return number, weights[order], kept


def together(queries: Queries, vocabulary: int) -> list[np.ndarray] | None:
    """Per term itself and the commoner terms that some query holds with it; None where these are too many pairs."""
    sizes = np.diff(queries.bounds)
    if int((sizes * (sizes + 1) // 2).sum()) > TERM_PAIRS:
        return None
    codes = []
    for a, b in zip(queries.bounds[:-1], queries.bounds[1:], strict=True):
        t = queries.terms[a:b]
        x, y = np.triu_indices(len(t))
        codes.append(t[x] * vocabulary + t[y])
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    own, other = np.divmod(code, max(1, vocabulary))
    return np.split(other, np.searchsorted(own, np.arange(1, vocabulary)))


def _forward(vocabulary):
    """Per text with a term: number of terms, and the vocabulary places and frequencies of those that queries hold."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            ids, body = batch.columns
            for first, last, hashes, owner in hashed_terms(body):
                rows = last - first
                lengths = np.bincount(owner, minlength=rows)
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                found = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                code, times = np.unique(owner[found] * max(1, len(known)) + place[found], return_counts=True)
                of, term = np.divmod(code, max(1, len(known)))
                at = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
                columns = [
                    ids.slice(first, rows), pa.array(lengths.astype(np.int64)),
                    pa.ListArray.from_arrays(at, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"]).filter(pa.array(lengths > 0))

    return run


def _frequencies(size: int):
    """Documents of this task that hold each term."""

    def run(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "held"])

    return run


def _spread(batch: pa.RecordBatch, number: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, coordinate) of the entries of a batch of the forward index, by row and number."""
    lists, times = batch.column("terms"), batch.column("times")
    sizes = np.diff(lists.offsets.to_numpy())
    row, term, tf = np.repeat(np.arange(len(sizes)), sizes), number[lists.flatten().to_numpy()], times.flatten().to_numpy().astype(np.int64)
    length = 75 + (25 * batch.column("n").to_numpy() * corpus.documents) // corpus.length
    value = corpus.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[row]))
    order = np.lexsort((term, row))
    order = order[value[order] > 0]
    return row[order], term[order], value[order]


def _placed(setup):
    """Forward rows with the two centres that are nearest to each, by the cosine of their coordinates."""

    def run(batches):
        number, corpus, centres = setup.value
        for batch in batches:
            row, term, value = _spread(batch, number, corpus)
            near = np.zeros((batch.num_rows, centres.shape[1]), np.float32)
            some, at = np.unique(row, return_index=True)
            if len(some):
                near[some] = np.add.reduceat(centres[term] * value[:, None].astype(np.float32), at)
            order = np.argsort(-near, axis=1, kind="stable")[:, :2].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(order[:, 0]), pa.array(order[:, -1])], [*batch.schema.names, "nearest", "second"]
            )

    return run


def choose_centres(forward: DataFrame, number: np.ndarray, corpus: Corpus, size: int) -> np.ndarray:
    """Terms by centres: different documents of the forward index, chosen by a hash, at length one."""
    count = max(1, min(CENTRES, CENTRE_BYTES // (4 * max(1, size))))
    drawn = forward.where("size(terms) > 0").select("n", "terms", "times").orderBy(F.xxhash64("terms", "times"), "n").limit(4 * count)
    drawn = drawn.dropDuplicates(["terms"]).limit(count).toArrow().combine_chunks()
    centres = np.zeros((size, count), np.float32)
    for batch in drawn.to_batches():
        row, term, value = _spread(batch, number, corpus)
        centres[term, row] = value
    return centres / np.maximum(np.linalg.norm(centres, axis=0), 1e-9)


class Shard(NamedTuple):
    """Forward index, posting lists in blocks and block summaries of some documents.

    ``at``, ``terms``, ``values`` are the documents' vectors. Block k is of term ``block_term[k]``, holds the documents
    ``postings[block_at[k]:block_at[k + 1]]`` and has the maxima ``top[top_at[k]:top_at[k + 1]]`` of ``top_term``.
    """

    at: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    block_term: np.ndarray
    block_at: np.ndarray
    postings: np.ndarray
    top_at: np.ndarray
    top_term: np.ndarray
    top: np.ndarray


KINDS = ("<i4", "<i4", "<i8", "<i4", "<i4", "<i4", "<i4", "<i4", "<i8")


def build_shard(rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, pairs: list[np.ndarray] | None, block: int = 0) -> Shard:
    """Index of ``rows`` documents whose entries come by row and term; neighbouring rows are alike."""
    block = block or BLOCK
    table = np.zeros((size, rows), np.int64)
    table[term, row] = value
    order = np.argsort(term, kind="stable")
    postings = row[order]
    held, start = np.unique(term[order], return_index=True)
    of_block, block_at, sizes, top_term, top = [], [], [], [], []
    for t, a, b in zip(held.tolist(), start.tolist(), [*start[1:].tolist(), len(postings)], strict=True):
        asked = np.arange(t, size) if pairs is None else pairs[t]
        cuts = np.arange(0, b - a, block)
        most = np.maximum.reduceat(table[np.ix_(asked, postings[a:b])], cuts, axis=1).T
        which, where = np.nonzero(most)
        of_block.append(np.full(len(cuts), t))
        block_at.append(a + cuts)
        sizes.append(np.bincount(which, minlength=len(cuts)))
        top_term.append(asked[where])
        top.append(most[which, where])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Shard(
        np.searchsorted(row, np.arange(rows + 1)), term, value, join(of_block), np.append(join(block_at), len(postings)),
        postings, np.append(0, np.cumsum(join(sizes))), join(top_term), join(top),
    )


def _indexed(setup):
    """Shards of the documents of a task, in the order in which they come: their ids, and the arrays as bytes."""

    def run(batches):
        number, corpus, pairs = setup.value
        size = len(corpus.weights)
        most = max(1, min(SHARD_DOCS, SHARD_CELLS // max(1, size)))

        def shard(parts):
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            found = build_shard(whole.num_rows, *_spread(whole, number, corpus), size, pairs)
            ids = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column("doc_id"))
            columns = [pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(found, KINDS, strict=True)]
            return pa.RecordBatch.from_arrays([ids, *columns], ["doc_ids", *Shard._fields])

        held, parts = 0, []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - held)
                batch = batch.slice(part.num_rows)
                parts.append(part)
                held += part.num_rows
                if held == most:
                    yield shard(parts)
                    held, parts = 0, []
        if held:
            yield shard(parts)

    return run


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end, one after another."""
    sizes = ends - starts
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())


def scores(shard: Shard, documents: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact scores of the documents, each of which has an entry; ``query`` holds the counts by term."""
    entries = ranges(shard.at[documents], shard.at[documents + 1])
    first = np.cumsum(shard.at[documents + 1] - shard.at[documents])
    return np.add.reduceat(shard.values[entries] * query[shard.terms[entries]], np.append(0, first[:-1]))


def search_shard(shard: Shard, terms: np.ndarray, query: np.ndarray, least: int, top: int, seed: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, opened blocks): all documents that can be among the ``top`` with a score of ``least`` or more.

    ``seed`` opens the blocks of the highest bounds only.
    """
    low, high = np.searchsorted(shard.block_term, terms), np.searchsorted(shard.block_term, terms, "right")
    blocks = ranges(low, high)
    if not len(blocks):
        return blocks, blocks, 0
    entries = ranges(shard.top_at[blocks], shard.top_at[blocks + 1])
    sizes = shard.top_at[blocks + 1] - shard.top_at[blocks]
    bounds = np.add.reduceat(shard.top[entries] * query[shard.top_term[entries]], np.append(0, np.cumsum(sizes)[:-1]))
    order = np.argsort(-bounds, kind="stable")
    head = order[:FIRST_BLOCKS]
    head = head[bounds[head] >= least]
    open_ = blocks[head]
    found = np.unique(shard.postings[ranges(shard.block_at[open_], shard.block_at[open_ + 1])])
    value = scores(shard, found, query) if len(found) else np.zeros(0, np.int64)
    opened = len(open_)
    if not seed:
        if len(value) >= top:
            least = max(least, int(np.partition(value, len(value) - top)[len(value) - top]))
        rest = order[FIRST_BLOCKS:]
        open_ = blocks[rest[bounds[rest] >= least]]
        more = np.setdiff1d(shard.postings[ranges(shard.block_at[open_], shard.block_at[open_ + 1])], found)
        if len(more):
            found, value = np.append(found, more), np.append(value, scores(shard, more, query))
        opened += len(open_)
    keep = value >= least
    return found[keep], value[keep], opened


def _best(kept: list[tuple], top: int) -> list[tuple]:
    """The ``top`` (score, id) by falling score, then rising id, null ids first."""
    return sorted(kept, key=lambda r: (-r[0], r[1] is not None, r[1]))[:top]


def _searched(setup, top: int, seed: bool):
    """The best documents of a task for each item; a threshold found in one shard holds in the next."""

    def run(batches):
        queries, size, least = setup.value
        kept: list[list[tuple]] = [[] for _ in queries.items]
        limits = least.copy()
        kind = None
        for batch in batches:
            kind = batch.column("doc_ids").type.value_type
            for k in range(batch.num_rows):
                ids = batch.column("doc_ids")[k].values
                shard = Shard(*[np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in zip(Shard._fields, KINDS, strict=True)])
                query = np.zeros(size, np.int64)
                for q, (a, b) in enumerate(zip(queries.bounds[:-1], queries.bounds[1:], strict=True)):
                    terms = queries.terms[a:b]
                    query[terms] = queries.counts[a:b]
                    found, value, _ = search_shard(shard, terms, query, int(limits[q]), top, seed)
                    query[terms] = 0
                    if len(value) > top:  # ties at the limit stay, ids decide between them
                        cut = np.partition(value, len(value) - top)[len(value) - top]
                        found, value = found[value >= cut], value[value >= cut]
                    if len(found):
                        mine = zip(value.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)
                        kept[q] = _best([*kept[q], *mine], top)
                        if len(kept[q]) == top:
                            limits[q] = max(limits[q], kept[q][-1][0])
        if kind is None:
            return
        rows = [(item, *r) for item, mine in zip(queries.items.tolist(), kept, strict=True) for r in mine]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item_no", "doc_id", "score"])

    return run


def _top_rows(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _search_block(documents: DataFrame, numbers: list[int], bodies: list[str | None], top: int) -> DataFrame | None:
    """(item_no, doc_id, score, rank) for one block of items; None where no text holds a term of theirs."""
    spark, send = documents.sparkSession, documents.sparkSession.sparkContext.broadcast
    texts.settings(spark)
    vocabulary, queries = read_queries(numbers, bodies)
    kind = documents.schema["doc_id"].dataType.simpleString()
    forward = materialize(documents.mapInArrow(_forward(send(vocabulary)), f"doc_id {kind}, n long, terms array<int>, times array<int>"), "forward")
    counts = forward.agg(F.count("*"), F.sum("n")).first()
    if not counts[0] or not len(vocabulary):
        return None
    forward = forward.where("size(terms) > 0")
    frequencies = np.zeros(len(vocabulary), np.int64)
    held = forward.mapInArrow(_frequencies(len(vocabulary)), "term int, held long").groupBy("term").agg(F.sum("held"))
    for term, n in held.collect():  # a row for each term of this block of queries
        frequencies[term] = n
    number, weights, queries = ranked(queries, frequencies, counts[0])
    if not len(weights):
        return None
    corpus = Corpus(counts[0], counts[1], weights)
    centres = choose_centres(forward, number, corpus, len(weights))
    columns = f"doc_id {kind}, n long, terms array<int>, times array<int>"
    placed = forward.mapInArrow(_placed(send((number, corpus, centres))), f"{columns}, nearest int, second int")
    numbered = placed.withColumn("at", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange("nearest", "second", F.xxhash64("at")).sortWithinPartitions("nearest", "second")
    arrays = ", ".join(f"{c} binary" for c in Shard._fields)
    index = materialize(
        dealt.select("doc_id", "n", "terms", "times").mapInArrow(_indexed(send((number, corpus, together(queries, len(weights))))), f"doc_ids array<{kind}>, {arrays}"),
        "index",
    )
    rows, least = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), np.ones(len(queries.items), np.int64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SHARDS_PER_BATCH))
    try:
        found_kind = f"item_no long, doc_id {kind}, score long"
        seeds = materialize(index.mapInArrow(_searched(send((queries, len(weights), least)), top, True), found_kind), "seeds")
        place = {item: k for k, item in enumerate(queries.items.tolist())}
        for item, score in _top_rows(seeds, top).where(F.col("rank") == top).select("item_no", "score").collect():  # a row for each item of this block
            least[place[item]] = score
        found = materialize(index.mapInArrow(_searched(send((queries, len(weights), least)), top, False), found_kind), "found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return _top_rows(found, top)


def ranked_search(
    documents: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Equal scores go by ascending id, null ids first. Null and empty texts have no terms: such documents are not
    counted, such items get no rows. A row that repeats a document is a document of its own, a row that repeats an
    item has a ranking of its own. Extra columns are ignored; empty tables give an empty table.
    """
    asked = materialize(items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("body"), F.monotonically_increasing_id().alias("item_no")), "items")
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    docs = documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    results = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block).where("body is not null").select("item_no", "body").collect()
        if mine:
            results.append(_search_block(docs, [r[0] for r in mine], [r[1] for r in mine], top))
    results = [r for r in results if r is not None]
    if not results:
        kind = docs.schema["doc_id"].dataType
        return asked.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.union, results).join(asked, "item_no").select("item_id", "rank", "doc_id", "score")

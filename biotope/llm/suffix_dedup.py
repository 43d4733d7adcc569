"""Removal of byte windows that occur twice, by a depth-limited most-significant-digit radix sort of suffixes.

A suffix matters only through its first ``window`` bytes, and its order only as far as equality: groups
that are still together at that depth are exactly the repeated windows. The passes run like this.

1. The first digit of a window is the rarest-looking anchor in it: the ``ANCHOR``-byte string of least
   hash (leftmost of equal ones). Equal windows have equal anchors in equal places, and neighbouring
   windows share one, so a text becomes runs of windows; a run travels as one narrow row.
2. Runs are grouped by anchor. An anchor with a single run is settled: its windows are unique. Runs
   equal as a whole are settled as well: all their windows repeat.
3. What is left are different runs with one anchor, around the edges of a match. Their bytes are
   fetched, and their windows sorted digit by digit (``DIGIT`` bytes, as 64-bit fingerprints); each pass
   drops the groups of one. An anchor with more runs than ``MOST_RUNS`` is not gathered: its windows
   are counted as rows, with partial aggregation.

Counts, not rows, meet in the groups of steps 1 and 2, so a passage that a third of all texts hold is a row
per task. Anchors, runs and digits are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.session import materialize

U = np.uint64
#: Bytes of an anchor; two windows without an equal string of this length are told apart in step 1.
ANCHOR = 100
#: Bytes of a digit.
DIGIT = 50
#: Runs of an anchor that one task gathers; beyond, windows are counted as rows.
MOST_RUNS = 20_000
#: Runs that count as hot: more copies than this, and than the rows over HOT_RUNS, so there are HOT_RUNS at most.
LEAST_COPIES, HOT_RUNS = 2_000, 50_000
#: Bytes of runs that a task sorts at a time.
SORT_BYTES = 2_000_000
#: Bytes of a text scanned at a time.
SCAN = 1 << 22


def window_hashes(buffer: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    count = len(buffer) - size + 1
    out = np.empty(max(0, count), U)
    for lo in range(0, count, texts.BLOCK):
        hi = min(count, lo + texts.BLOCK)
        sums = texts.prefix_sums(buffer[lo : hi + size - 1])
        _, down = texts.powers(hi - lo)
        out[lo:hi] = texts.mix((sums[size:] - sums[:-size]) * down[: hi - lo])
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values: minima from the left and right ends of blocks."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def runs(buffer: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """(text index, start, number of windows, anchor hash, run hash) of a piece's runs; starts are inside the text."""
    none = np.zeros(0, np.int64)
    if len(buffer) < window:
        return none, none, none, none.view(U), none.view(U)
    hashes = window_hashes(buffer, anchor)
    # as many bits whatever the piece, so that equal windows break ties alike wherever they stand
    bits = U((SCAN + window).bit_length())
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U)
    at = (sliding_least(packed, window - anchor + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    place = np.flatnonzero(np.arange(len(at)) + window <= offsets[owner + 1])
    if not len(place):
        return none, none, none, none.view(U), none.view(U)
    anchors, owner = at[place], owner[place]
    opens = np.ones(len(place), bool)
    opens[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(opens)
    count = np.diff(np.append(head, len(place)))
    start = place[head]
    whole = texts.hash_spans(buffer, start, start + count + window - 1)
    return owner[head], start - offsets[owner[head]], count, hashes[anchors[head]], whole


def _run_rows(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            column = batch.column(3)
            for first, last, raw, offsets in texts.pieces(column):
                # a very long text is scanned in stretches that overlap by a window less one byte
                cuts = [(0, raw, offsets)] if len(raw) <= SCAN else [
                    (lo, raw[lo : lo + SCAN + window - 1], np.array([0, min(SCAN + window - 1, len(raw) - lo)])) for lo in range(0, len(raw), SCAN)
                ]
                for shift, part, bounds in cuts:
                    owner, start, count, anchors, whole = runs(part, bounds, window, anchor)
                    if len(owner):
                        pick = pa.array(owner + first)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(k).take(pick) for k in range(3)]
                            + [pa.array(x) for x in (anchors.view(np.int64), whole.view(np.int64), start + shift, count.astype(np.int32))],
                            ["doc_id", "text_key", "n_bytes", "anchor", "run", "start", "windows"],
                        )

    return run


def repeated_windows(buffer: np.ndarray, starts: np.ndarray, window: int, digit: int = DIGIT) -> np.ndarray:
    """Which of the windows at these places occur twice among them: one pass a digit, groups of one drop out."""
    out = np.zeros(len(starts), bool)
    active = np.arange(len(starts))
    group = np.zeros(len(starts), U)
    sums = texts.prefix_sums(buffer)
    _, down = texts.powers(len(buffer))
    for depth in range(0, window, digit):
        a = starts[active] + depth
        b = a + min(digit, window - depth)
        key = texts.mix(texts.mix((sums[b] - sums[a]) * down[a]) + group)
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        keep = times[inverse] > 1
        active, group = active[keep], texts.mix(inverse[keep].astype(U) + U(depth + 1))
        if not len(active):
            return out
    out[active] = True
    return out


def _spans(table: pa.Table, window: int) -> pa.Table:
    """Intervals of repeated windows of the gathered runs that are not settled."""
    runs_of = list(zip(table.column("anchor").to_pylist(), table.column("run").to_pylist(), strict=True))
    first = {}
    for k, name in enumerate(runs_of):
        first.setdefault(name, k)
    table = table.take(pa.array(sorted(first.values())))
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("body")]
    sizes = np.array([len(p) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    count = table.column("windows").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    hit = repeated_windows(np.concatenate(parts), offsets[owner] + inside, window)
    hit &= (table.column("times").to_numpy() == 1)[owner]
    place = np.flatnonzero(hit)
    opens = np.ones(len(place), bool)
    opens[1:] = (np.diff(place) > 1) | (owner[place[1:]] != owner[place[:-1]])
    head, tail = place[opens], place[np.append(np.flatnonzero(opens)[1:] - 1, len(place) - 1)] if len(place) else place
    who = owner[head]
    start = table.column("start").to_numpy()[who]
    return pa.table(
        {
            "text_key": table.column("text_key").take(pa.array(who)),
            "n_bytes": table.column("n_bytes").take(pa.array(who)),
            "lo": pa.array(start + inside[head]),
            "hi": pa.array(start + inside[tail] + window),
        }
    )


def repeated_spans(docs: DataFrame, window: int = 400, anchor: int = ANCHOR, most_runs: int = MOST_RUNS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(text_key, n_bytes, spans): for each text with repeated windows, the byte intervals they cover.

    ``text_key`` is ``xxhash64`` of the text; equal texts share a row. Intervals may overlap.
    """
    spark = docs.sparkSession
    texts.settings(spark)
    anchor = min(anchor, window)
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.col(text).alias("body"))
    source = source.where(F.col("n_bytes") >= window)
    rows = materialize(
        source.mapInArrow(_run_rows(window, anchor), f"doc_id {kind}, text_key long, n_bytes long, anchor long, run long, start long, windows int"), "runs"
    )
    kinds = rows.groupBy("anchor", "run").agg(F.count("*").alias("times"), F.min(F.struct("text_key", "n_bytes", "start", "windows", "doc_id")).alias("at"))
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("runs"), F.min("times").alias("least")).where("runs > 1 and least = 1")
    # runs of very many copies, at most HOT_RUNS of them, are sent to the rows; the others meet by their hash
    limit = max(LEAST_COPIES, rows.count() // HOT_RUNS)
    settled = kinds.where("times > 1").select("anchor", "run", "times")
    hot_runs = F.broadcast(settled.where(F.col("times") > limit).drop("times"))
    few = rows.join(hot_runs, ["anchor", "run"], "left_anti").join(settled.where(F.col("times") <= limit).drop("times"), ["anchor", "run"], "left_semi")
    whole = rows.join(hot_runs, ["anchor", "run"], "left_semi").union(few).select("text_key", "n_bytes", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + window - 1).alias("hi"))
    open_runs = materialize(
        kinds.join(shared.select("anchor", (F.col("runs") > most_runs).alias("hot")), "anchor").select("anchor", "run", "times", "hot", "at.*"), "open"
    )
    total = open_runs.agg(F.sum(F.col("windows") + window)).first()[0] or 0
    wanted = open_runs.groupBy("doc_id", "text_key", "n_bytes").agg(F.collect_list(F.struct("anchor", "run", "times", "hot", "start", "windows")).alias("wanted"))
    left, right = source.alias("s"), wanted.alias("w")
    found = left.join(right, F.expr("s.text_key = w.text_key and s.n_bytes = w.n_bytes and s.doc_id <=> w.doc_id")).select("s.text_key", "s.n_bytes", "s.body", "w.wanted")
    fetched = materialize(
        found.select("text_key", "n_bytes", F.col("body").cast("binary").alias("body"), F.explode("wanted").alias("r"))
        .select("text_key", "n_bytes", "r.*", F.substring("body", F.col("r.start").cast("int") + 1, F.col("r.windows") + window - 1).alias("body")),
        "fetched",
    )
    buckets = int(total // SORT_BYTES) + 1

    def sorted_spans(table: pa.Table) -> pa.Table:
        return _spans(table, window)

    edges = fetched.where("not hot").withColumn("bucket", F.expr(f"pmod(xxhash64(anchor), {buckets})")).groupBy("bucket").applyInArrow(
        sorted_spans, "text_key long, n_bytes long, lo long, hi long"
    )
    singles = (
        fetched.where("hot").select("anchor", "text_key", "n_bytes", "start", "body", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("o"))
        .select("anchor", "text_key", "n_bytes", (F.col("start") + F.col("o")).alias("lo"), F.md5(F.substring("body", F.col("o") + 1, F.lit(window))).alias("digest"))
        .distinct()
    )
    again = singles.groupBy("anchor", "digest").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "digest")
    counted = singles.join(again, ["anchor", "digest"]).select("text_key", "n_bytes", "lo", (F.col("lo") + window).alias("hi"))
    return whole.union(edges).union(counted).groupBy("text_key", "n_bytes").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; intervals that touch make one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def dedup_windows(docs: DataFrame, window: int = 400, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of each row; ``kept`` holds the bytes that are left.

    Null texts count as empty. Repeated rows repeat each other's windows and lose them. Extra columns are
    ignored; an empty table gives an empty table.
    """
    found = repeated_spans(docs, window, id_column=id_column, text=text, **options)
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    keyed = source.withColumns({"text_key": F.xxhash64("body"), "n_bytes": F.octet_length("body").cast("long")})

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for body, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cuts = merged([(s["lo"], s["hi"]) for s in spans or ()])
                edges = [0, *[x for c in cuts for x in c], len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cuts else body
                for column, value in zip(out, (left, len(body), len(body) - len(left), len(cuts)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return keyed.join(found, ["text_key", "n_bytes"], "left").select("doc_id", "body", "spans").mapInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long"
    )

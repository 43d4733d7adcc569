"""N-gram Jaccard self-join by rare-first prefix filtering, and the components of its links.

A text's set holds its distinct word n-grams (a shorter text is one n-gram, a text without words has
none). Two texts link when ``100 * |x & y| >= percent * |x | y|``.

1. Equal sets form one class; everything after works on classes.
2. Every n-gram gets its document frequency, counted over all texts. Only n-grams that two different
   sets share can be in an overlap, so a class whose shared n-grams are fewer than the overlap that a
   link needs is done. (A bounded list of the most frequent n-grams is counted first; all classes agree
   that these come last, so no task ever holds the occurrences of a hot n-gram.)
3. The others order their n-grams rarest first and emit the prefix, with positions. A pair must share
   an n-gram of both prefixes and pass the length filter, the positional filter and the suffix filter.
4. Within an n-gram's group each member is paired with the group's most typical one first, then with a
   few others; what by then lies in one component needs no more pairs. Members outside the group's largest
   component are paired with every member of another one that the filters let through. Each pair is verified
   once, by intersecting its shared n-grams; pairs tried in one round are left out of the next. Links inside a
   component that is already known are not looked for: the result is the components.

Hashes: an n-gram is a 64-bit hash of which 48 bits plus the bucket travel; a class is 64 bits and a size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm import texts
from biotope.llm.components import components
from biotope.session import materialize

#: Most n-grams that may be treated as hot; 8 MB as an array. Which n-grams are in the list changes the
#: order of work, never the links.
HOT_LIST = 1 << 20
#: An n-gram is hot from this share of all texts on, and from this many texts on.
HOT_SHARE, HOT_LEAST = 1000, 1000

#: Words of 64 bits in the signature of a class's shared n-grams.
SIGNATURE = 8
#: Further rounds of star pairs, each around another member of a group, before all pairs that are left.
STAR_ROUNDS = 4
#: N-grams are counted in buckets of about so many, of which there are so many at least.
BUCKET_GRAMS, LEAST_BUCKETS = 1 << 20, 128

U = np.uint64
BITS = [f"b{k}" for k in range(SIGNATURE)]


def text_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, n-gram hashes, bounds by row, class by row) of each piece; hashes of a row ascend and are distinct."""
    for first, last, raw, offsets in texts.pieces(column):
        buffer = texts.lowered(raw)
        starts, ends, doc = texts.word_spans(buffer, offsets)
        words = texts.hash_spans(buffer, starts, ends)
        grams, owner = texts.hash_grams(words, doc, n)
        rows = last - first
        count = np.bincount(doc, minlength=rows)
        at = np.searchsorted(owner, np.arange(rows + 1))
        begin = np.searchsorted(doc, np.arange(rows + 1))
        sets = []
        for r in range(rows):
            if count[r] >= n:
                sets.append(np.unique(grams[at[r] : at[r + 1]]))
            elif count[r]:
                whole, _ = texts.hash_grams(words[begin[r] : begin[r + 1]], np.zeros(count[r], np.int64), int(count[r]))
                sets.append(whole)
            else:
                sets.append(np.zeros(0, U))
        sizes = np.array([len(s) for s in sets])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        sums = np.concatenate([[U(0)], np.cumsum(texts.mix(flat ^ texts.LENGTH), dtype=U)])
        keys = texts.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(U))
        yield first, last, flat, bounds, keys


def _classes(n: int, floor: int):
    """Per row its class and set size; per piece the n-grams that at least ``floor`` of its sets hold."""

    def run(batches):
        for batch in batches:
            *own, body = batch.columns
            names = [*batch.schema.names[:-1], "set_key", "n_shingles", "gram", "times"]
            for first, last, flat, bounds, keys in text_sets(body, n):
                rows = last - first
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, rows) for c in own], pa.array(keys.view(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                    names,
                )
                gram, times = np.unique(flat, return_counts=True)
                gram, times = gram[times >= floor], times[times >= floor]
                if len(gram):
                    none = pa.nulls(len(gram), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.nulls(len(gram), c.type) for c in own], none, none, pa.array(gram.view(np.int64)), pa.array(times.astype(np.int64))],
                        names,
                    )

    return run


BLOB = "bucket int, high binary, low binary, keys binary, sizes binary, held binary, hot_keys binary, hot_sizes binary, hot_held binary, hot binary"


def _blobs(n: int, buckets: int, hot):
    """Per piece and bucket: the distinct sets' n-grams as 6-byte values, with the classes that hold them.

    Hot n-grams need no counting: they travel as places in the hot list, to the bucket of their class.
    """
    kinds = [pa.int32()] + [pa.binary()] * 9
    names = [x.split()[0] for x in BLOB.split(", ")]

    def run(batches):
        heavy = hot.value
        for batch in batches:
            for _, _, flat, bounds, keys in text_sets(batch.column(0), n):
                _, once = np.unique(keys, return_index=True)
                sizes = np.diff(bounds)
                keep = np.zeros(len(keys), bool)
                keep[once] = True
                owner = np.repeat(np.arange(len(keys)), sizes)
                held = keep[owner]
                flat, owner = flat[held], owner[held]
                rank = np.minimum(np.searchsorted(heavy, flat), max(0, len(heavy) - 1))
                known = heavy[rank] == flat if len(heavy) else np.zeros(len(flat), bool)
                hot_owner, rank = owner[known], rank[known]
                hot_place = (keys[hot_owner] % U(buckets)).astype(np.int64)
                flat, owner = flat[~known], owner[~known]
                place = (flat & U(0xFFFF)).astype(np.int64) % buckets
                order = np.argsort(place.astype(np.uint16), kind="stable")
                flat, owner, place = flat[order], owner[order], place[order]
                order = np.argsort(hot_place.astype(np.uint16), kind="stable")
                hot_owner, rank, hot_place = hot_owner[order], rank[order], hot_place[order]
                at, hot_at = (np.searchsorted(x, np.arange(buckets + 1)) for x in (place, hot_place))
                columns: list[list] = [[] for _ in names]
                for b in np.union1d(place, hot_place).tolist():
                    part, hot_part = slice(at[b], at[b + 1]), slice(hot_at[b], hot_at[b + 1])
                    values = flat[part] >> U(16)
                    row = [b, (values >> U(16)).astype("<u4").tobytes(), (values & U(0xFFFF)).astype("<u2").tobytes()]
                    for holders in (owner[part], hot_owner[hot_part]):
                        who, size = np.unique(holders, return_counts=True)
                        row += [keys[who].tobytes(), sizes[who].astype("<u4").tobytes(), size.astype("<u4").tobytes()]
                    row.append(rank[hot_part].astype("<u4").tobytes())
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _shared(hot):
    """For one bucket: per class its n-grams that another class has as well, with their frequencies."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, heavy = U(key[0].as_py()), hot.value
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        grams = ((read("high", "<u4").astype(U) << U(16)) | read("low", "<u2").astype(U)) << U(16) | bucket
        hot_rank = read("hot", "<u4").astype(np.int64)
        named, who = np.unique(np.concatenate([read("keys", U), read("hot_keys", U)]), return_inverse=True)
        size_of = np.zeros(len(named), np.int64)
        size_of[who] = np.concatenate([read("sizes", "<u4"), read("hot_sizes", "<u4")])
        owner = np.repeat(who, np.concatenate([read("held", "<u4"), read("hot_held", "<u4")]))
        cold = len(grams)
        grams = np.concatenate([grams, heavy[hot_rank]])
        times = np.concatenate([np.zeros(cold, np.int64), (1 << 40) + hot_rank])
        order = np.lexsort((owner, grams, times))
        grams, owner, times = grams[order], owner[order], times[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner, times = grams[first], owner[first], times[first]
        _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        times = np.where(times > 0, times, counts[inverse])
        keep = times > 1
        grams, owner, times = grams[keep], owner[keep], times[keep]
        order = np.argsort(owner, kind="stable")
        grams, owner, times = grams[order], owner[order], times[order]
        who, at = np.unique(owner, return_index=True)
        at = pa.array(np.append(at, len(owner)).astype(np.int32))
        return pa.table(
            {
                "set_key": pa.array(named[who].view(np.int64)),
                "n": pa.array(size_of[who]),
                "grams": pa.ListArray.from_arrays(at, pa.array(grams.view(np.int64))),
                "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64))),
            }
        )

    return run


def shared_grams(docs: DataFrame, text: str, n: int, hot_grams: np.ndarray, total: int) -> DataFrame:
    """(set_key, n, items): for each class its n-grams held by other classes too, as ``struct(times, gram)``.

    ``total`` n-grams in all sets decide the number of buckets, so that a task's share does not grow with the input.
    """
    spark = docs.sparkSession
    # a class has a row per bucket that holds a shared n-gram of it: with many buckets, as many rows as n-grams
    buckets = min(1 << 16, max(LEAST_BUCKETS, total // BUCKET_GRAMS))
    hot = spark.sparkContext.broadcast(hot_grams)
    blobs = docs.select(F.col(text).alias("text")).mapInArrow(
        _blobs(n, buckets, hot), BLOB
    )
    parts = blobs.groupBy("bucket").applyInArrow(
        _shared(hot), "set_key long, n long, grams array<long>, times array<long>"
    )
    return parts.groupBy("set_key", "n").agg(
        F.flatten(F.collect_list(F.arrays_zip(F.col("times"), F.col("grams")))).alias("items")
    )


def _overlap_needed(percent: int, a: str, b: str):
    """Smallest overlap with which sets of these sizes link: ceil(percent * (a + b) / (100 + percent))."""
    return F.expr(f"({percent} * ({a} + {b}) + {100 + percent - 1}) div {100 + percent}")


def _signature(grams: str) -> list:
    """Bitmap of the n-grams as ``SIGNATURE`` longs."""

    def word(k: int):
        mine = f"filter({grams}, g -> pmod(shiftrightunsigned(g, 40), {SIGNATURE}) = {k})"
        return F.expr(f"aggregate({mine}, 0L, (acc, g) -> acc | shiftleft(1L, cast(pmod(shiftrightunsigned(g, 48), 64) as int)))")

    return [word(k).alias(name) for k, name in enumerate(BITS)]


def _filters(percent: int):
    """Length, positional and suffix filter of two prefix rows x and y.

    A bit that one signature has and the other lacks stands for an n-gram, at least, that they do not share.
    """
    missing = lambda x, y: " + ".join(f"bit_count({x}.{b} & ~{y}.{b})" for b in BITS)
    need = _overlap_needed(percent, "x.n", "y.n")
    return (
        F.expr(f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}")
        & (F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")) >= need)
        & (F.least(F.expr(f"x.shared - ({missing('x', 'y')})"), F.expr(f"y.shared - ({missing('y', 'x')})")) >= need)
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Before the intersection the suffix filter drops those whose shared
    n-grams, counted by classes of their hashes, cannot reach the overlap."""
    one = lambda side: sets.select(
        F.col("set_key").alias(side), F.col("n").alias(f"n{side}"), F.col("grams").alias(f"g{side}"), F.col("profile").alias(f"p{side}")
    )
    joined = pairs.join(one("a"), "a").join(one("b"), "b")
    need = _overlap_needed(percent, "na", "nb")
    most = F.aggregate(
        F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return joined.where(most >= need).where(F.size(F.array_intersect("ga", "gb")) >= need).select("a", "b")


def jaccard_classes(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, carry: Sequence[str] = ()
) -> DataFrame:
    """Per row of ``docs``: id, set_key and n_shingles of its class, and ``root``, the class that names its component.

    Null and blank texts: n_shingles 0, root null, linked with nothing. Repeated rows and ids: each row has
    its own result. Extra columns are ignored but for those named in ``carry``. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts.settings(spark)
    own = docs.select(F.col(id_column).alias("doc_id"), *carry)
    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in own.schema)
    rows = materialize(
        docs.select(F.col(id_column).alias("doc_id"), *carry, F.col(text).alias("text")).mapInArrow(
            _classes(n, 8), f"{kinds}, set_key long, n_shingles long, gram long, times long"
        ),
        "sets",
    )
    members = rows.where("gram is null").select("doc_id", *carry, "set_key", "n_shingles")
    floor = max(HOT_LEAST, members.count() // HOT_SHARE)
    hot = [
        r[0]
        for r in rows.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("t")).where(F.col("t") >= floor)
        .orderBy(F.desc("t"), "gram").limit(HOT_LIST).select("gram").collect()
    ]
    hot_grams = np.sort(np.array(hot, np.int64).view(U))

    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    shared = shared_grams(docs, text, n, hot_grams, total).where(F.size("items") * 100 >= F.col("n") * percent)
    rarest = shared.select("set_key", "n", F.array_sort("items").alias("items"))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter("grams", lambda g: F.shiftrightunsigned(g, 60) == k)).cast("long"))
    sets = materialize(
        rarest.select("set_key", "n", F.transform("items", lambda i: i["grams"]).alias("grams"))
        .select("set_key", "n", "grams", buckets.alias("profile"), *_signature("grams")),
        "candidates",
    )
    prefix = materialize(
        sets.select("set_key", "n", F.size("grams").alias("shared"), *BITS, F.posexplode("grams").alias("k", "gram"))
        .select("gram", "set_key", "n", (F.col("n") - F.col("shared") + F.col("k")).alias("pos"), "shared", *BITS)
        .where(F.expr(f"pos <= n - ({percent} * n + 99) div 100")),
        "prefix",
    )
    centre = (
        prefix.groupBy("gram")
        .agg(F.count("*").alias("size"), F.min(F.struct((F.col("pos") / F.col("n")).alias("at"), "n", "set_key", "pos", "shared", *BITS)).alias("c"))
        .where("size > 1")
        .select("gram", *[F.col(f"c.{x}").alias(x) for x in ("set_key", "n", "pos", "shared", *BITS)])
    )
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = (
        prefix.alias("x").join(centre.alias("y"), "gram").where("x.set_key <> y.set_key").where(_filters(percent))
        .select(*pair(F.col("x.set_key"), F.col("y.set_key"))).distinct()
    )
    tried = None

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, of those that were not tried before."""
        nonlocal tried
        fresh = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = fresh if tried is None else tried.union(fresh)
        return materialize(_verified(fresh, sets, percent), "links")

    links = linked(star)
    known = components(links)

    def parts() -> DataFrame:
        columns = ["gram", "set_key", "n", "pos", "shared", *BITS, F.coalesce("root", "set_key").alias("part")]
        return materialize(prefix.join(known, prefix.set_key == known.node, "left").select(*columns), "placed")

    placed = parts()
    for k in range(STAR_ROUNDS):
        other = F.min(F.struct(F.xxhash64("set_key", F.lit(k)).alias("at"), "n", "set_key", "pos", "shared", *BITS, "part"))
        around = placed.groupBy("gram").agg(other.alias("c"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
        around = around.select("gram", *[F.col(f"c.{x}").alias(x) for x in ("set_key", "n", "pos", "shared", *BITS, "part")])
        more = (
            placed.alias("x").join(around.alias("y"), "gram").where("x.part <> y.part").where(_filters(percent))
            .select(*pair(F.col("x.set_key"), F.col("y.set_key"))).distinct()
        )
        more = linked(more)
        if more.isEmpty():
            break
        links = links.union(more)
        known = components(links)
        placed = parts()
    largest = F.max_by("part", F.struct("members", "part"))
    main = placed.groupBy("gram", "part").agg(F.count("*").alias("members")).groupBy("gram").agg(largest.alias("main"))
    marked = placed.join(main, "gram").withColumn("outside", F.col("part") != F.col("main"))
    rest = (
        marked.where("outside").alias("x").join(marked.alias("y"), F.expr("x.gram = y.gram and x.part <> y.part and (not y.outside or x.set_key < y.set_key)"))
        .where(_filters(percent))
        .select(*pair(F.col("x.set_key"), F.col("y.set_key"))).distinct()
    )
    more = linked(rest)
    whole = components(links.union(more))
    return members.join(whole, members.set_key == whole.node, "left").select(
        "doc_id", *carry, "n_shingles", "set_key", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_key")).alias("root")
    )


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links, the row's own included."""
    rows = materialize(jaccard_classes(docs, id_column, text, n, percent), "classes")
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )

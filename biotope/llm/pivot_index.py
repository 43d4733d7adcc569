"""Near-copies among vectors by a pivot-permutation index.

1. Equal vectors form one class; everything after works on classes, with their numbers of rows.
2. A bounded sample gives the reference points (pivots), thinned so that no two lie close together: a sample
   crowded by near-copies would order them by noise. Every class is described by its nearest pivots in order.
3. Pivots are ranked by the number of classes that name them, rare ones first. Classes that share ``shared`` of
   their ``nearest`` pivots also share one of the ``nearest - shared + 1`` rarest of each, so only these enter
   the inverted lists. A list longer than ``BLOCK`` is cut by a hash of the class, and its blocks meet in pairs.
4. Within a list the shared pivots are counted. A pair with enough of them, met in the list of its first shared
   pivot only, is verified by its cosine. Pairs never leave the task: each class gives its number of
   linked rows and one edge to the first class of its connected part.

Two vectors with fewer shared pivots than ``shared`` are not found, everything else is exact. Lists grow with the
square root of the number of classes, as the number of pivots does up to ``MOST_PIVOTS``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.llm.components import components
from biotope.session import materialize, ship_package

LEAST_PIVOTS, MOST_PIVOTS = 256, 8192
#: Most bytes of pivots that travel to the workers.
PIVOT_BYTES = 64 << 20
#: No two pivots have a larger cosine than this.
PIVOT_COSINE = 0.8
#: Nearest pivots that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 12, 3
#: Rows of a block of a list, and of a stripe of the product of two blocks.
BLOCK, STRIPE = 2048, 512


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length one in double precision; None where null, empty, zero or not finite throughout."""
    out: list[np.ndarray | None] = []
    for item in column:
        part = item.values if item.is_valid else None
        if part is None or len(part) == 0 or part.null_count:
            out.append(None)
            continue
        v = part.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        v = v / top  # so that squares neither overflow nor vanish
        out.append(v / np.sqrt(v @ v))
    return out


def _keyed(batches):
    for batch in batches:
        *own, vectors = batch.columns
        units = [None if v is None else (v + 0.0).astype("<f8").tobytes() for v in unit_vectors(vectors)]  # one zero, no -0.0
        keys = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
        names = [*batch.schema.names[:-1], "key", "unit"]
        yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names)


def pivot_count(classes: int) -> int:
    """Power of two from four times the square root of the classes on, within the bounds."""
    count = LEAST_PIVOTS
    while count < MOST_PIVOTS and count * count < 16 * classes:
        count *= 2
    return count


def choose_pivots(units: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` well separated vectors (padded with zeros to one length) of a sample of twice as many."""
    size = max(1, units.agg(F.max(F.octet_length("unit"))).first()[0] or 8)
    count = max(1, min(count, PIVOT_BYTES // (2 * size)))
    drawn = [r[0] for r in units.orderBy(F.xxhash64("key"), "key").select("unit").limit(2 * count).collect()]
    sample = np.zeros((len(drawn), size // 8))
    for row, raw in zip(sample, drawn, strict=True):
        row[: len(raw) // 8] = np.frombuffer(raw)
    chosen = np.zeros_like(sample[:count])
    n = 0
    for row in sample:
        if n == count:
            break
        if n == 0 or (chosen[:n] @ row).max() <= PIVOT_COSINE:
            chosen[n] = row
            n += 1
    return chosen[:n]


def _stacked(units: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros or cut at ``width``."""
    out = np.zeros((len(units), width))
    for row, raw in zip(out, units, strict=True):
        v = np.frombuffer(raw)[:width]
        row[: len(v)] = v
    return out


def _described(pivots, nearest: int):
    """Per class the numbers of its nearest pivots, nearest first; ties go to the smaller number."""

    def run(batches):
        points = pivots.value
        for batch in batches:
            near = _stacked(batch.column("unit").to_pylist(), points.shape[1]) @ points.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :nearest].astype(np.int32)
            bounds = pa.array(np.arange(0, order.size + 1, order.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("times"), batch.column("unit"), pa.ListArray.from_arrays(bounds, pa.array(order.ravel()))],
                ["class", "times", "unit", "nearest"],
            )

    return run


def _firsts(mask: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Per row of the group the smallest row of its connected part; ``mask`` marks the links of left and right rows."""
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(mask, new[right], n).min(axis=1))
        new[right] = np.minimum(new[right], np.where(mask, new[left][:, None], n).min(axis=0))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(cosine: float, shared: int):
    """For one list (or a pair of its blocks): linked rows of each class, and the first class of its connected part.

    Rows of the group carry their block; classes of one block meet each other, those of two blocks across.
    Links are marks in a matrix of two blocks, they are never listed.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, low, high = (k.as_py() for k in key)
        table = table.sort_by("class")
        block = table.column("block").to_numpy()
        classes, times = table.column("class").to_numpy(), table.column("times").to_numpy()
        raw = table.column("unit").to_pylist()
        width = np.array([len(u) for u in raw])
        units = _stacked(raw, int(width.max()) // 8)
        ranks = table.column("ranks").combine_chunks()
        owner = np.repeat(np.arange(len(raw)), np.diff(ranks.offsets.to_numpy()))
        # pivots that one class alone names cannot be shared
        named, place, held = np.unique(ranks.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.cumsum(held > 1) - 1
        keep = held[place] > 1
        sets = np.zeros((len(raw), int((held > 1).sum())), np.float32)
        sets[owner[keep], column[place[keep]]] = 1
        before = int((held[named < pivot] > 1).sum())
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        mask = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), STRIPE):
            some = left[at : at + STRIPE]
            enough = sets[some] @ sets[right].T >= shared
            if before:
                enough &= sets[some, :before] @ sets[right, :before].T == 0
            enough &= (units[some] @ units[right].T >= cosine) & (width[some][:, None] == width[right]) & (some[:, None] != right)
            mask[at : at + STRIPE] = enough
        rows, columns = mask.any(axis=1), mask.any(axis=0)
        mask, left, right = mask[rows][:, columns], left[rows], right[columns]
        if not mask.size:
            return pa.table({c: pa.array([], pa.int64()) for c in ("class", "linked", "root")})
        linked = np.zeros(len(classes), np.int64)
        linked[left] = mask @ times[right]
        if low != high:
            linked[right] = times[left] @ mask
        first = _firsts(mask, left, right, len(classes))
        some = np.flatnonzero(linked)
        return pa.table({"class": pa.array(classes[some]), "linked": pa.array(linked[some]), "root": pa.array(classes[first[some]])})

    return run


def near_copies(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, nearest: int = NEAREST, shared: int = SHARED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    ``n_links`` counts the other rows at the cosine or above, ``component_id`` is the smallest id reachable by
    links, ``kept`` says whether that is the row's own. Null, empty and zero vectors and vectors with null or
    non-finite components link with nothing; vectors of different lengths do not link either. Rows that repeat an
    id are rows of their own. A row without an id takes part, but names no component: where no row has an id it is
    null, and ``kept`` then true. Other columns are ignored; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    kind = own.schema["vec_id"].dataType.simpleString()
    rows = materialize(own.mapInArrow(_keyed, f"vec_id {kind}, key binary, unit binary"), "vectors")
    classes = materialize(
        rows.where("key is not null").groupBy("key").agg(F.min("unit").alias("unit"), F.count("*").alias("times")).withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    rows = rows.select("vec_id", "key")
    count = classes.count()
    pivots = choose_pivots(classes, pivot_count(count))
    nearest = min(nearest, max(1, len(pivots)))
    shared = min(shared, nearest)
    sent = spark.sparkContext.broadcast(pivots)
    described = materialize(
        classes.mapInArrow(_described(sent, nearest), "class long, times long, unit binary, nearest array<int>"), "described"
    )
    named = described.select(F.explode("nearest").alias("pivot")).groupBy("pivot").count().collect()  # a row per pivot
    rank = {p: k for k, (p, _) in enumerate(sorted(named, key=lambda r: (r[1], r[0])))}
    ranks = F.array(*[F.lit(rank.get(p, len(rank))) for p in range(len(pivots))]) if len(pivots) else F.array(F.lit(0))
    ranked = described.select("class", "times", "unit", F.array_sort(F.transform("nearest", lambda p: F.get(ranks, p))).alias("ranks"))
    posted = ranked.select("class", "times", "unit", "ranks", F.explode(F.slice("ranks", 1, nearest - shared + 1)).alias("pivot"))
    lengths = posted.groupBy("pivot").agg(F.count("*").alias("length"))  # a row per pivot
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    listed = (
        posted.join(F.broadcast(lengths.where("length > 1").select("pivot", blocks.alias("blocks"))), "pivot")
        .withColumn("block", F.pmod(F.xxhash64("class", "pivot"), F.col("blocks")).cast("int"))
        .select("*", other.alias("other"))
        .select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "times", "unit", "ranks")
    )
    found = materialize(
        listed.groupBy("pivot", "low", "high").applyInArrow(_linked(cosine, shared), "class long, linked long, root long"), "linked"
    )
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    of_class = (
        classes.select("class", "key", "times").join(sums, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
        .select("key", (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    )
    placed = materialize(rows.join(of_class, "key", "left"), "placed")
    least = placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return placed.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )

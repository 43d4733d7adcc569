"""Jump consistent hashing of stable keys to shards, in built-in column expressions only.

The generator of the published algorithm is a 64-bit linear congruence. Spark's long multiplication
raises on overflow in ANSI mode, so the product is put together from 16- and 32-bit parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from biotope.session import materialize

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_LOW32 = 0xFFFFFFFF
#: Fixed value: 2**31 as a double.
SCALE = 2147483648.0


def _low_product(a: Column, b: int) -> Column:
    """Low 32 bits of a * b for 32-bit values."""
    return ((a.bitwiseAND(F.lit(0xFFFF)) * b) + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW32))


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, as two 32-bit halves: state * MULTIPLIER + 1 modulo 2**64."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW32
    small = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_low)
    large = F.shiftright(low, 16) * F.lit(m_low)
    sum_low = small.bitwiseAND(F.lit(_LOW32)) + F.shiftleft(large.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = F.shiftright(small, 32) + F.shiftright(large, 16) + F.shiftright(sum_low, 32)
    new_high = carried + _low_product(low, m_high) + _low_product(high, m_low)
    return new_high.bitwiseAND(F.lit(_LOW32)), sum_low.bitwiseAND(F.lit(_LOW32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard from 0 to ``shards - 1`` of a long key; a null key counts as 0.

    Each jump lands at least one further, so ``shards`` steps are always enough. With one more shard
    a row stays where it is or goes to the new shard.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW32)).alias("low"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next_state(s["high"], s["low"])
        draw = F.shiftright(high, 1) + F.lit(1)
        jump = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(SCALE) / draw.cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), s["next"].alias("at"), jump.cast("long").alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def with_slots(rows: DataFrame, shard: str, order: list[str], blocks: int) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... inside each shard in the given order, without a task that holds a shard.

    The rows are dealt by ranges of (shard, order) into blocks and written once; a block's rows are
    numbered from the total of the blocks before it, so only the block counts meet in one place. The place in
    the input comes last in the order, so that rows equal in all of it are dealt to several blocks as well.
    """
    order = [*order, "_at"]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(placed.repartitionByRange(blocks, shard, *order).withColumn("_block", F.spark_partition_id()), "slots")
    counts = dealt.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(shard, "_block").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside))
    return numbered.join(offsets, [shard, "_block"]).withColumn("slot", F.col("_before") + F.col("_row") - 1).drop("_block", "_row", "_before", "_at")


def shard_documents(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    The shard follows from the id and the number of shards alone; equal ids share a shard. A null id
    counts as 0, a null text as empty (size 1, crc32 0). An id that is no number counts by its 64-bit hash. Slots are
    gapless from 0; repeated rows take neighbouring slots. Extra columns are ignored; an empty table gives an empty table.
    """
    key = F.col(id_column) if isinstance(docs.schema[id_column].dataType, NumericType) else F.when(F.col(id_column).isNotNull(), F.xxhash64(id_column))
    blocks = blocks or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], blocks).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

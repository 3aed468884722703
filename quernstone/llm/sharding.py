"""Shards along a Hilbert curve over metadata dimensions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bits of each quantised dimension.
BITS = 5


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The position on the Hilbert curve of a grid cell, whose coordinates are ``bits``-bit integers.

    Works down the bits as a fold whose state is the coordinates (inverse undo of the curve's
    rotations), then Gray-codes and interleaves them.
    """
    n = len(axes)
    names = [f"x{i}" for i in range(n)]

    def undo(state: Column, bit: Column) -> Column:
        low = bit - 1
        x = [state[c] for c in names]
        for i in range(n):
            is_set = x[i].bitwiseAND(bit) != 0
            if i == 0:
                x[0] = F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0])
            else:
                swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
                x[0], x[i] = F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap)), F.when(is_set, x[i]).otherwise(x[i].bitwiseXOR(swap))
        return F.struct(*[v.alias(c) for v, c in zip(x, names, strict=True)])

    def finish(state: Column) -> Column:
        gray = [state[names[0]]]
        for c in names[1:]:
            gray.append(state[c].bitwiseXOR(gray[-1]))
        last, turn = gray[-1], F.lit(0)
        for q in range(1, bits):
            turn = turn.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
        out = F.lit(0)
        for b in range(bits):
            for i, g in enumerate(gray):
                out = out + F.shiftleft(F.shiftright(g.bitwiseXOR(turn), b).bitwiseAND(F.lit(1)), b * n + n - 1 - i)
        return out

    start = F.struct(*[a.cast("int").alias(c) for a, c in zip(axes, names, strict=True)])
    steps = F.array(*[F.lit(1 << q) for q in range(bits - 1, 0, -1)])
    return F.aggregate(steps, start, undo, finish)


def log_bucket(size: Column, bits: int = BITS) -> Column:
    """Half-octave buckets of a positive size, the last one open."""
    return F.least(F.floor(2 * F.log2(size.cast("double"))), F.lit((1 << bits) - 1)).cast("int")


def hash_bucket(value: Column, bits: int = BITS) -> Column:
    """A stateless bucket of a categorical value; a predicate's constant is quantised the same way. Null is 0."""
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("int")


def shard(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(key, size, text_crc32, hilbert, law, shard, slot, grown_shard) for every row.

    Rows are sorted by the Hilbert index of (size, *categories) and cut into ``shards`` runs whose
    counts are at most one apart (law ``rows``). The rank is global without a global task:
    rows are range-partitioned on the order, numbered within their range, and ranges are offset by
    the counts before them (one number a partition). Ties on the curve go by key, then checksum,
    so one hot cell spreads over ranges. Null text counts as none (size 1, checksum 0), null
    categories as bucket 0, null keys come first; equal rows each get a slot. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(body).cast("long") + 1
    narrow = docs.select(F.col(key), size.alias("size"), F.crc32(body).alias("text_crc32"), *[hash_bucket(F.col(c)).alias(f"bucket_{i}") for i, c in enumerate(categories)])
    axes = [log_bucket(F.col("size")), *[F.col(f"bucket_{i}") for i in range(len(categories))]]
    narrow = materialise(narrow.withColumn("hilbert", hilbert_index(axes)).select(key, "size", "text_crc32", "hilbert"), "shard-rows")
    order = ["hilbert", key, "text_crc32"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged.select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")).drop("at"), "shard-ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    whole = Window.orderBy("range")  # one row a range
    before = counts.select("range", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = ranged.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    first = F.expr(f"(cast(shard as bigint) * total + {shards - 1}) div {shards}")
    return ranked.select(key, "size", "text_crc32", "hilbert", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_manifest(sharded: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the range of curve positions, by which a reader skips whole shards."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("hilbert").alias("first_cell"), F.max("hilbert").alias("last_cell"))

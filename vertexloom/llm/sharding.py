"""Sharding by jump consistent hashing, in DataFrame functions only.

The jump hash of a key walks a fixed pseudo-random sequence of shard numbers;
the shard is the last one below the shard count.  No ring or table is kept,
and one more shard takes rows only into itself.

Defined results: the key is ``doc_id`` (null: 0), so rows with one doc_id
share a shard; a null text has no bytes and the checksum of no bytes.  Slots
number each shard's rows from 0 without gaps, by sub-buckets of the rows'
numbers in the written table, so that no task orders a whole shard, and any
number of equal rows are spread; equal rows get different slots.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Low, middle and high parts of the multiplier 2862933555777941757 of the jump hash.
LOW16, NEXT16, HIGH32 = 2862933555777941757 & 0xFFFF, 2862933555777941757 >> 16 & 0xFFFF, 2862933555777941757 >> 32
MASK16, MASK32 = 0xFFFF, 0xFFFFFFFF


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among ``shards``.

    The 64-bit state is kept as two 32-bit halves, and its product with the
    multiplier is summed from parts that stay below 2**63, because ordinary
    Spark arithmetic rejects overflow.  Each step moves on by one shard at
    least, so ``shards`` steps are enough.
    """

    def step(s: Column, _: Column) -> Column:
        hi, lo = s["hi"], s["lo"]
        p0, p1 = lo * F.lit(LOW16), lo * F.lit(NEXT16)
        low = p0 + F.lit(1) + F.shiftleft(p1.bitwiseAND(F.lit(MASK16)), 16)
        carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
        high = carry + hi * F.lit(LOW16) + F.shiftleft((hi * F.lit(NEXT16)).bitwiseAND(F.lit(MASK16)), 16) + lo * F.lit(HIGH32)
        high = high.bitwiseAND(F.lit(MASK32))
        # double division as in the definition: (b + 1) * 2**31 / ((key >> 33) + 1)
        jump = F.floor((s["j"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(high.alias("hi"), low.bitwiseAND(F.lit(MASK32)).alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    key = key.cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK32)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def gapless(rows: DataFrame, group: str, name: str, least: int = 64, most_rows: int = 100_000) -> DataFrame:
    """Number each group's rows from 0 without gaps in column ``name``.

    Rows are written with a number, whose hash deals them to (group,
    sub-bucket) windows; a table of groups x sub-buckets counts gives where
    each sub-bucket starts.  There are ``least`` sub-buckets, or more, so that
    a window has at most about ``most_rows`` rows.  Both sides are dealt by the
    same keys, so the rows are shuffled once.
    """
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    sub_buckets = max(least, -(-rows.count() // most_rows))
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64("_row"), F.lit(sub_buckets)))
    counts = rows.groupBy(group, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_sub").orderBy("_row")) - 1)
    return numbered.join(before, [group, "_sub"]).withColumn(name, (F.col("_before") + F.col("_rn")).cast("long")).drop("_sub", "_rn", "_before", "_row")


def shard_documents(docs: DataFrame, *, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"), jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"))
    return gapless(rows, "shard", "slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Operator 7, sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard follows from the key and the number of shards alone: no ring table, and with one more shard a key
either stays or moves into the new shard.

Defined cases: a null key is hashed like a value of its own; a null text has no bytes (size 8, crc32 of no bytes);
repeated rows each get a slot; extra columns of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, written

LAW = "key"
N_SHARDS = 24
#: Equal rows that come apart in one step.
COPIES_AT_ONCE = 1 << 16

_MULTIPLIER = 2862933555777941757
_M32 = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * _MULTIPLIER + 1 modulo 2**64 on 32-bit halves; no product reaches 2**63, so ANSI mode raises nothing."""
    a_hi, a_lo = _MULTIPLIER >> 32, _MULTIPLIER & _M32
    a1, a0 = a_lo >> 16, a_lo & 0xFFFF
    upper = lo * F.lit(a1)
    low = lo * F.lit(a0) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    h1, h0 = a_hi >> 16, a_hi & 0xFFFF

    def times(x: Column, y1: int, y0: int) -> Column:
        return (x * F.lit(y0) + F.shiftleft((x * F.lit(y1)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_M32))

    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + times(hi, a1, a0) + times(lo, h1, h0)
    return high.bitwiseAND(F.lit(_M32)), low.bitwiseAND(F.lit(_M32))


def jump_hash(key: Column, n: int) -> Column:
    """STRUCT<shard INT, grown INT>: the shard of a 64-bit key among n shards, and among n + 1."""

    def move(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        # (b + 1) * 2**31 / ((key >> 33) + 1), in doubles, as the paper has it
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] < n, F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), j.alias("j"))).otherwise(s)

    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_M32)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    # every step raises j by one at least: n steps reach the end for any key
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(n)),
        start,
        move,
        lambda s: F.struct(s["b"].cast("int").alias("shard"), F.when(s["j"] == n, F.lit(n)).otherwise(s["b"]).cast("int").alias("grown")),
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assigns each row a shard and a gapless slot in it.

    Rows that are equal in all that counts (key, size, checksum) are counted before they are shuffled, and come apart
    again at the end. A slot is the row's place in its (shard, bucket) plus the rows of the shard's earlier buckets.
    Buckets follow from key and content, as many as there are shuffle partitions: neither a whole shard nor the rows of
    one key are ranked in one task.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    buckets = max(1, shuffle_partitions(docs.sparkSession))
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(content) + F.lit(8)).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(1)), F.lit(buckets)).cast("int")
    same = same.select("*", jump_hash(F.xxhash64("doc_id"), n_shards).alias("at"), bucket.alias("bucket"))
    same = written(same.select("doc_id", "size", "text_crc32", "copies", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"), "bucket"), "shard-rows")
    until = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = same.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    first = same.withColumn("until", F.sum("copies").over(until)).join(starts, ["shard", "bucket"])
    first = first.withColumn("first", F.col("start") + F.col("until") - F.col("copies"))
    # in two steps, so that no array grows with the number of copies
    blocks = first.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    each = blocks.withColumn("copy", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + COPIES_AT_ONCE, F.col("copies")) - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("copy")).cast("long").alias("slot"), "grown_shard")


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jump_sharding": op7_jump_sharding}

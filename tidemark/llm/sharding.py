"""Jump consistent hashing: stable keys to shards without a ring table (DataFrame functions only).

A key walks through the shard counts at which it would move; the last stop below n is its
shard among n. The walk doesn't depend on n, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exclusive_offsets, rows_or_one, staged

# Fixed values of the published algorithm: the generator's multiplier, and 2^31.
MULTIPLIER = 2862933555777941757
SCALE = 2147483648.0
#: Stops on the way to n shards number about ln n. Walks of more stops than this go on in a second loop.
USUAL_STOPS = 64


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, in decimals: bigint arithmetic raises on overflow."""
    product = key * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")
    return F.pmod(product + F.lit(1).cast("decimal(1,0)"), _number(2**64)).cast("decimal(20,0)")


def _next_stop(stop: Column, key: Column) -> Column:
    signed = F.when(key >= _number(2**63), key - _number(2**64)).otherwise(key).cast("bigint")
    high = F.shiftrightunsigned(signed, 33) + F.lit(1)
    return F.floor((stop + 1) * (F.lit(SCALE) / high.cast("double"))).cast("bigint")


def jump_hash(key: Column, shards: int, grown: int | None = None) -> Column:
    """struct(shard, grown_shard): the key's shard among `shards` and among `grown` (default
    one more). key: a bigint, taken as 64 unsigned bits; null counts as 0."""
    grown = grown or shards + 1
    if not 1 <= shards <= grown:
        raise ValueError("shards must be positive and not exceed grown")
    key = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    start = F.struct(
        F.when(key < 0, key + _number(2**64)).otherwise(key).cast("decimal(20,0)").alias("key"),
        F.lit(0).cast("bigint").alias("next"),
        F.lit(-1).cast("bigint").alias("shard"),
        F.lit(-1).cast("bigint").alias("grown"),
    )

    def step(at: Column, _: Column) -> Column:
        after = _next_key(at["key"])
        moved = F.struct(
            after.alias("key"),
            _next_stop(at["next"], after).alias("next"),
            F.when(at["next"] < shards, at["next"]).otherwise(at["shard"]).alias("shard"),
            at["next"].alias("grown"),
        )
        return F.when(at["next"] < grown, moved).otherwise(at)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(grown, USUAL_STOPS))), start, step)
    if grown > USUAL_STOPS:
        walk = F.when(walk["next"] < grown, F.aggregate(F.sequence(F.lit(1), F.lit(grown - USUAL_STOPS)), walk, step)).otherwise(walk)
    return F.struct(walk["shard"].cast("int").alias("shard"), walk["grown"].cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 100_000) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard of every row.

    Only the key and shard count decide. Integer keys are hashed as they are, others by
    xxhash64; a null key counts as 0. A null text has size 1 and checksum 0. Repeated rows
    each get a slot of their own; other columns are ignored. An empty table gives no rows.
    slot numbers each shard from 0 without gaps: rows are counted in hash buckets of bounded
    size, whose offsets are added, so that no shard is ordered in one task.
    """
    kind = dict(docs.dtypes)[key]
    number = F.col(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(key).isNull(), 0).otherwise(F.xxhash64(key))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        jump_hash(number, shards).alias("_to"),
        (F.octet_length(body).cast("bigint") + 1).alias("_size"),
        F.crc32(body).alias("_crc"),
    )
    rows = staged(rows.select("_key", "_to.*", "_size", "_crc"))
    buckets = rows_or_one(rows, rows_per_bucket)
    same = ["_key", "shard", "grown_shard", "_size", "_crc"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_size", "_crc"), F.lit(buckets)))
    offsets = exclusive_offsets(rows, ["shard"], "_bucket", F.col("_copies"), "_base")
    w = Window.partitionBy("shard", "_bucket").orderBy(F.col("_key").asc_nulls_last(), "_crc", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_copies").over(w), F.lit(0))).join(offsets, ["shard", "_bucket"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return rows.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_base") + F.col("_before") + F.col("_copy")).cast("bigint").alias("slot"),
        "grown_shard",
    )

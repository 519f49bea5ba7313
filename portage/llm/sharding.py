"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered within shard and bucket, then moved by the sizes of the shard's earlier buckets.
SLOT_BUCKETS = 4096
_DIGITS = 13  # hex digits that a double holds exactly


def _point(key: Column, shard: int) -> Column:
    """A number in (0, 1] that depends on key and shard alone."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    whole = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return (whole + 1) / F.lit(float(16**_DIGITS))


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard with the smallest ``-ln(point) / weight``; a shard's share is its weight's, ties go to the smaller number.

    A new shard takes rows only into itself, since the other shards' values do not change. A null key counts as ''.
    Weights must be positive.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, one per shard")
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [
        F.struct((-F.ln(_point(text, shard)) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard"))
        for shard, weight in sorted(weights.items())
    ]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    ``slot`` numbers a shard's rows from 0 without gaps, ordered by bucket of the key, doc_id, checksum and size. Only
    these few columns are shuffled, never texts, and a shard's rows are spread over 4096 buckets, so no task holds a
    whole shard. Null text counts as empty; repeated rows get slots of their own; an empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bucket = F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int") % SLOT_BUCKETS
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    checksum = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    grown_shard = rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    placed = docs.select(
        "doc_id", size.alias("size"), checksum.alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"), grown_shard.alias("grown_shard"), bucket.alias("bucket"),
    )
    sizes = docs.select(rendezvous(F.col("doc_id"), weights).alias("shard"), bucket.alias("bucket"))
    sizes = sizes.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    slot = (F.col("offset") + F.col("rank")).cast("long")
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", slot.alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, weights: Mapping[int, float], path: str) -> None:
    """Every column of every document under ``path/shard=<n>``; large shards are split over several tasks."""
    clash = [name for name in docs.columns if name.lower() == "shard"]
    if clash:
        raise ValueError("documents already have a column named shard")
    placed = docs.withColumn("shard", rendezvous(F.col("doc_id"), weights))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)

"""Operator 5: rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage_table

SHARDS = 8


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: of all shards the one with the least -ln(u) / weight, u drawn by hashing (key, shard).

    Shard k's draw depends on the key and k alone, so a further shard takes keys only for itself and a dropped one
    gives up only its own; a shard of twice the weight draws twice the keys.
    """
    draws = []
    for k, w in enumerate(weights):
        h = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"#{k}"))), 11)
        u = (h.cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / w).alias("cost"), F.lit(k).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(0)


def shard_records(docs: DataFrame, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents(doc_id, text); other columns are not read.

    shard: by rendezvous hashing over `weights` (SHARDS equal ones by default); grown_shard: with one shard more.
    slot numbers a shard's rows from 0 without gaps; equal rows may exchange slots. A null text counts as none
    (size 1); a row without doc_id is keyed by its text. Repeated keys go to one shard and get slots of their own.
    """
    weights = weights or [1.0] * SHARDS
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64(text).cast("string")))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    out = numbered(stage_table(rows, "shards"), ["shard"], ["doc_id", "_row"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

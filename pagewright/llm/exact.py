"""Operator 8: exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size; the distinct blocks are sorted and numbered; then pairs of neighbouring
names are numbered in turn, halving each document until one name is left. Two names of a level are equal exactly
when the blocks beneath are, so no hash is trusted: hashes only route, and blocks that share one are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

BLOCK = 2048


def _names(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct values with an integer each: partition by partition in sorted order."""
    return values.select(*keys).distinct().sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def block_names(docs: DataFrame, text: Column, carried: list[str], block: int = BLOCK, route: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(_row, _pos, _n, name, *carried at position 0) of the blocks of whole texts. `route` may give unlike blocks the
    same hash; then all blocks are staged once and named by their bytes."""
    raw = text.cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * block + 1, F.lit(block)))
    rows = docs.withColumn("_row", F.monotonically_increasing_id())  # before blocks multiply the rows
    rows = rows.select("_row", count.alias("_n"), *carried, F.posexplode(cut).alias("_pos", "_block"))
    rows = rows.withColumn("_h", route("_block"))
    first = [F.when(F.col("_pos") == 0, F.col(c)).alias(c) for c in carried]
    # Text is shuffled once, for the distinct blocks; only hashes travel to meet the names.
    names = stage_table(_names(rows, ["_h", "_block"], "name").select("_h", "name"), "names")
    if names.groupBy("_h").count().where("count > 1").isEmpty():
        return rows.select("_row", "_pos", "_n", "_h", *first).join(names, "_h").drop("_h")
    # Row numbers may differ from one run of a plan to the next, so both sides come from one table.
    rows = stage_table(rows, "blocks")
    names = stage_table(_names(rows, ["_h", "_block"], "name"), "names")
    return rows.select("_row", "_pos", "_n", "_h", "_block", *first).join(names, ["_h", "_block"]).drop("_h", "_block")


def name_documents(docs: DataFrame, text: Column, carried: list[str], block: int = BLOCK, route: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(_row, level, name, *carried): texts are equal exactly when (level, name) is."""
    named = stage_table(block_names(docs, text, carried, block, route), "named")
    done, level = None, 0
    while True:
        one = named.where("_n = 1").select("_row", F.lit(level).alias("level"), "name", *carried)
        done = one if done is None else done.unionByName(one)
        if named.where("_n > 1").isEmpty():
            return done
        side = lambda k, c: F.max(F.when(F.col("_pos") % 2 == k, F.col(c)))
        pairs = named.where("_n > 1").groupBy("_row", F.floor(F.col("_pos") / 2).cast("int").alias("_half")).agg(F.ceil(F.max("_n") / 2).cast("int").alias("_n"), side(0, "name").alias("_a"), F.coalesce(side(1, "name"), F.lit(-(1 << 62))).alias("_b"), *[F.max(F.when(F.col("_pos") == 0, F.col(c))).alias(c) for c in carried])
        pairs = stage_table(pairs.withColumnRenamed("_half", "_pos"), "pairs")
        names = stage_table(_names(pairs, ["_a", "_b"], "name"), "names")
        named = stage_table(pairs.join(names, ["_a", "_b"]).drop("_a", "_b"), "named")
        level += 1


def exact_duplicates(docs: DataFrame, block: int = BLOCK, route: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of documents(doc_id, text).

    Null counts as the empty text. Of equal texts the row with the largest doc_id stays; of rows that also share
    that doc_id, one. A null doc_id is the smallest. Texts are not normalised. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", "text", F.sha2(text, 256).alias("text_sha256"))
    named = stage_table(name_documents(docs, text, ["doc_id", "text_sha256"], block, route), "identity")
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), (-F.col("_row")).alias("row")))
    groups = stage_table(named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = named.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (-F.col("_row") == F.col("best.row")).alias("kept"), "text_sha256")

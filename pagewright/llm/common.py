"""Shared pieces: scratch tables, numbering without a single task, connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Space and \t \n \v \f \r, the only characters that part words here.
WS = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a folder of its own, in local mode only: on a
    cluster no machine's folder would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tables written inside the innermost last_table().
_written: list[str] = []


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, lost executors cost no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_table(spark: SparkSession, plan: Callable[[], DataFrame], name: str) -> DataFrame:
    """The staged result of plan(); the tables that were written on the way are deleted, as nothing reads them any more."""
    global _written
    before, _written = _written, []
    try:
        out = stage_table(plan(), name)
        drop_tables(spark, _written[:-1])
        before.append(_written[-1])
        return out
    finally:
        _written = before


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Before Python work: small Arrow batches, as texts may be long, and workers that find this package where it is not
    installed. Both are settings of the session, which it keeps."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return df


def numbered(df: DataFrame, within: list[str], order: list[str], out: str, chunks: int = 1024) -> DataFrame:
    """Adds `out`: 0, 1, 2 ... without gaps inside each `within` group.

    A group is cut into `chunks` hash chunks of its `order` columns; rows are numbered inside a chunk and the
    chunk's offset is added. The offsets table has one row for each group and chunk, so no task ever holds a group.
    `order` must identify a row up to rows that may be exchanged.
    """
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    key = [*within, "_chunk"]
    ahead = Window.partitionBy(*within).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    return ranked.join(offsets, key).withColumn(out, (F.col("_offset") + F.col("_rank")).cast("long")).drop("_chunk", "_offset", "_rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each written to the shared folder, until the
    edges no longer change. Neighbour minima are aggregates, so a hub of any degree is combined before the shuffle.
    """
    cur = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, now = None, ()
    while now != before:
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = stage_table(small.select("e.*").where("u <> v").distinct(), "edges")
        before, now = now, tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return found.unionByName(roots.join(found, "node", "left_anti"))

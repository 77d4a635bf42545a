"""Reading parsed documents and writing results; everything stays a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("flags", T.IntegerType()), T.StructField("font", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
BLOCK = T.StructType([T.StructField("lines", T.ArrayType(LINE)), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
PAGE = T.StructType([T.StructField("blocks", T.ArrayType(BLOCK))])
TREE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pages", T.ArrayType(PAGE))])
PAGE_CAP = 50
SIZE_CAP = 100 * 1024 * 1024


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Parser output, a JSON object a line: {doc_id, pages: [{blocks: [{lines: [{spans: [...]}]}]}]}."""
    return spark.read.schema(TREE).json(path)


def tree_spans(trees: DataFrame) -> DataFrame:
    """One row for each span of the first PAGE_CAP pages, with its decoded font."""
    pages = trees.select("doc_id", F.posexplode(F.slice("pages", 1, PAGE_CAP)).alias("page", "p"))
    blocks = pages.select("doc_id", "page", F.posexplode("p.blocks").alias("block", "b"))
    lines = blocks.select("doc_id", "page", "block", F.posexplode("b.lines").alias("line", "l"))
    spans = lines.select("doc_id", "page", "block", "line", F.posexplode("l.spans").alias("span", "s")).select("doc_id", "page", "block", "line", "span", "s.*")
    bit = lambda n: F.col("flags").bitwiseAND(1 << n) != 0
    return spans.withColumns({"is_superscript": bit(0), "is_italic": bit(1), "is_serifed": bit(2), "is_monospaced": bit(3), "is_bold": bit(4)})


def tree_blocks(trees: DataFrame) -> DataFrame:
    """Blocks of three characters and more: texts joined by a blank, the largest size, any bold, any italic, the hull."""
    s = tree_spans(trees).where(F.trim("text") != "")
    order = F.struct("line", "span", F.trim("text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), " ")
    box = [F.min(F.get("bbox", 0)).alias("x0"), F.min(F.get("bbox", 1)).alias("y0"), F.max(F.get("bbox", 2)).alias("x1"), F.max(F.get("bbox", 3)).alias("y1")]
    b = s.groupBy("doc_id", "page", "block").agg(text.alias("text"), F.max("size").alias("font_size"), F.bool_or("is_bold").alias("is_bold"), F.bool_or("is_italic").alias("is_italic"), *box)
    return b.where(F.length("text") >= 3).withColumn("seq", (F.col("page") * 100_000 + F.col("block")).cast("int")).drop("block")


def valid_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that pass input validation: the suffix and at most 100 MB; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(F.lower("path").endswith(".pdf") & (F.col("length") <= SIZE_CAP))


def write_outlines(results: DataFrame, path: str) -> None:
    """One JSON object for each document."""
    results.write.mode("overwrite").json(path)


def write_debug(rows: DataFrame, path: str) -> None:
    """Any rows as JSON objects, nulls included, to look into."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder for each document, with its report as text; of rows(doc_id, report)."""
    reports.select("doc_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_training(rows: DataFrame, path: str) -> None:
    """{blocks, labels} objects, one for each document, from rows(doc_id, seq, text, ..., label)."""
    cols = [c for c in rows.columns if c not in ("doc_id", "label")]
    pair = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("o"), F.struct(*cols).alias("b"), "label")))
    rows.groupBy("doc_id").agg(pair.alias("r")).select("doc_id", F.transform("r", lambda x: x["b"]).alias("blocks"), F.transform("r", lambda x: x["label"]).alias("labels")).write.mode("overwrite").json(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path)
    return rows.select("doc_id", F.explode(F.arrays_zip("blocks", "labels")).alias("x")).select("doc_id", "x.blocks.*", F.col("x.labels").alias("label"))

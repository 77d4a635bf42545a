"""The corpus pipeline: language ID, line dedup, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import WS, documents, last_table
from pagewright.llm.language import identify, is_accepted, train
from pagewright.llm.lines import drop_recurring_lines
from pagewright.llm.near import near_duplicates
from pagewright.llm.packing import pack_documents
from pagewright.llm.queries import vocabulary
from pagewright.llm.suffix import repeated_passages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_SHINGLE = 5  # words; op9 has its own


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; others, and those without letters, go."""
    out = identify(docs.select(*COLUMNS), train(docs))
    return out.where(is_accepted(F.col("lang_pred"), F.col("score"))).select(*COLUMNS)


def _with_text(docs: DataFrame) -> DataFrame:
    """Documents that have text left, with its length."""
    return docs.where(F.btrim("text", F.lit(WS)) != "").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines whose template recurs, but for its first occurrence."""
    return _with_text(drop_recurring_lines(docs.select(*COLUMNS)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    kept = last_table(spark, lambda: near_duplicates(docs, NEAR_SHINGLE).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages that a document of smaller id has."""
    rest = docs.select("doc_id", "text", F.to_json(F.struct("lang", "source")).alias("rest"))
    out = repeated_passages(rest, want_text=True, extra="rest")
    out = out.withColumn("rest", F.from_json("extra", "lang string, source string"))
    return _with_text(out.select("doc_id", "text", "rest.lang", "rest.source", F.lit(0).cast("long").alias("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]

#: Byte-level BPE, MinHash and suffix arrays are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a table; what it wrote on the way is deleted, and the results
    themselves once the last is there."""

    def all_stages() -> DataFrame:
        docs = documents(spark, sf_dir)
        for name, stage in STAGES:
            docs = last_table(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
        return docs

    return last_table(spark, all_stages, "pipeline")

"""Operators over DataFrames of documents or blocks: each runs a declared plan and returns a lazy DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.dialect import DUCK, SPARK
from ..plans import analysis, features, outline, reports

PLANS = outline.PLANS
__all__ = ["PLANS", "analysis", "features", "oracle", "reports", "run", "run_on_blocks"]


def run(name: str, table: DataFrame, relation: str = "documents") -> DataFrame:
    """The plan `name` over documents(doc_id, text, ...), or over pages(page_id, html) with relation="pages"."""
    return _run(PLANS[name](SPARK), table, relation)


def run_on_blocks(name: str, blocks: DataFrame) -> DataFrame:
    """The plan over parsed blocks(doc_id, seq, page, text, font_size, is_bold, is_italic, x0, y0, x1, y1), without the line adapter."""
    return _run(PLANS[name](SPARK, adapted=False), blocks, "blocks")


def _run(sql: str, table: DataFrame, relation: str) -> DataFrame:
    view = f"pw_{relation}_{uuid.uuid4().hex}"
    table.createOrReplaceTempView(view)
    named = f"{relation} AS (SELECT * FROM {view})"
    try:
        return table.sparkSession.sql(f"WITH {named}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {named} {sql}")
    finally:
        table.sparkSession.catalog.dropTempView(view)


def oracle(name: str) -> str:
    """The same plan for DuckDB."""
    return PLANS[name](DUCK)

"""Operators beyond SQL: full text cleaning with back-references, leader groups of headers and footers, page functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dialect import SPARK
from ..plans.outline import CORE, Plan, all_rows, lvl, title_text
from . import _run, run

SIMILAR = 0.8
ON_PAGES = 0.7


def repeated(text: str | None, least: int = 8) -> bool:
    """Whether a substring of `least` characters or more stands three times in a row. Only starts of equal grams are
    compared, as the pattern itself tries every length at every place."""
    n = len(text or "")
    if n < 3 * least:
        return False
    places: dict[str, list[int]] = {}
    for i in range(n - least + 1):
        gram = text[i : i + least]
        if gram not in places:
            places[gram] = [i]
            continue
        for j in reversed(places[gram]):
            far = i - j
            if j + 3 * far > n:
                break
            if far >= least and text.startswith(gram, i + far) and text[j : j + 2 * far] == text[i : i + 2 * far]:
                return True
        places[gram].append(i)
    return False


#: Any character but those that end a line.
ANY = r"[^\n\r\x85\u2028\u2029]"


def once(text: str | None) -> str | None:
    """The text with substrings of two characters and more that stand three times or more in a row there once. Lengths
    that no such substring has are not tried."""
    if text is None or len(text) < 6:
        return text
    most = len(text) // 3 if repeated(text) else 7
    return re.sub(rf"({ANY}{{2,{most}}})\1{{2,}}", r"\1", text)


def _once(texts: pd.Series) -> pd.Series:
    return texts.map(once, na_action="ignore")


def clean_block(text: Column) -> Column:
    """White space, spaced capitals and letters, repeated letters, a known corruption, substrings repeated three times."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(text, r"\b([A-Z])\s+([A-Z])\s+([A-Z])\b", "$1$2$3")
    text = F.regexp_replace(text, r"\b([A-Za-z])\s+([A-Za-z])\s+([A-Za-z])\s+([A-Za-z])\b", "$1$2$3$4")
    text = F.regexp_replace(text, r"([a-zA-Z])\1{2,}", "$1")
    text = F.regexp_replace(text, r"\b[a-z]\s+([a-z]{4,})\s+[a-z]+o{3,}r\s+", "$1 for ")
    return F.pandas_udf(_once, StringType())(text)


def clean_span(text: Column) -> Column:
    """Spans of four characters and more: repeated letters, then a lone letter before a word."""
    fixed = F.regexp_replace(F.regexp_replace(text, r"([a-zA-Z])\1{3,}", "$1"), r"\b[a-zA-Z]\s+([a-zA-Z]{3,})", "$1")
    return F.when(F.length(text) < 4, text).otherwise(fixed)


def clean_blocks(docs: DataFrame) -> DataFrame:
    return run("block_scan", docs).select("doc_id", "seq", clean_block(F.col("text")).alias("block_text"), clean_span(F.col("text")).alias("span_text"))


def similarity(a: str, b: str) -> float:
    """Jaccard of the words, 0.8 at least where one text holds the other; 0 when either is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return max(len(x & y) / len(x | y), SIMILAR if a in b or b in a else 0.0)


def _leaders(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one document and region: candidates join the first leader that is similar; leaders on most pages stay."""
    groups: dict[str, set[int]] = {}
    for text, page in pdf.sort_values(["page", "seq"])[["text", "page"]].itertuples(index=False):
        lead = next((k for k in groups if similarity(text, k) >= SIMILAR), text)
        groups.setdefault(lead, set()).add(page)
    total = pdf["page"].nunique()
    rows = [(pdf["doc_id"].iloc[0], pdf["kind"].iloc[0], k, len(v), len(v) / total) for k, v in groups.items() if len(v) / total >= ON_PAGES]
    return pd.DataFrame(rows, columns=["doc_id", "kind", "text_pattern", "n_pages", "repetition_rate"])


def leader_groups(docs: DataFrame) -> DataFrame:
    """Header and footer patterns of each document; candidates of a document are bounded by its capped pages."""
    found = run("header_footer_candidates", docs)
    return found.groupBy("doc_id", "kind").applyInPandas(_leaders, "doc_id long, kind string, text_pattern string, n_pages long, repetition_rate double")


RECORDS = Plan(
    [*CORE, all_rows],
    lambda d: f"SELECT doc_id, {title_text(d, 'kind = 0 AND page = 0')} AS title, transform(array_sort(collect_list(CASE WHEN head THEN struct(pos, {lvl(d)} AS level, htext AS text, page + 1 AS page) END)), x -> struct(x.level AS level, x.text AS text, x.page AS page)) AS outline, struct(max(doc_language) AS detected_language, cast(max(n_blocks) AS bigint) AS total_blocks_analyzed) AS metadata FROM rows_ GROUP BY doc_id",
)


def result_records(docs: DataFrame) -> DataFrame:
    """(doc_id, title, outline: array of level, text, page, metadata) as the result sink writes it."""
    return _run(RECORDS(SPARK), docs, "documents")


def layout_objects(rectangles: DataFrame, tables: DataFrame) -> DataFrame:
    """Rectangles and a parser's tables(doc_id, page, rows, cols, x0, y0, x1, y1) as objects of a page, numbered by kind."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0")) - 1
    found = tables.select("doc_id", "page", F.concat(F.lit("table_"), n).alias("id"), F.lit("table").alias("type"), "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "rows", "cols")
    return found.unionByName(rectangles, allowMissingColumns=True)


def process_pages(blocks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of `function` over the blocks of each page. Batches are cut at pages here, which costs less than a group each."""

    def pages(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            doc, page = pdf["doc_id"].to_numpy(), pdf["page"].to_numpy()
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (page[1:] != page[:-1])) + 1
            if len(cuts):
                yield pd.concat([function(pdf.iloc[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], ignore_index=True)
            held = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
        if held is not None and len(held):
            yield function(held)

    return blocks.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq").mapInPandas(pages, schema)


def _longest(pdf: pd.DataFrame) -> pd.DataFrame:
    size, seq = np.array([len(t) for t in pdf["text"]]), pdf["seq"].to_numpy()
    return pdf.iloc[[np.lexsort((seq, -size))[0]]][["doc_id", "page", "seq", "text"]]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES = {
    "clean_blocks_full": lambda spark, sf_dir: clean_blocks(_docs(spark, sf_dir)),
    "result_records": lambda spark, sf_dir: result_records(_docs(spark, sf_dir)),
    "leader_groups": lambda spark, sf_dir: leader_groups(_docs(spark, sf_dir)),
    "page_function": lambda spark, sf_dir: process_pages(run("block_scan", _docs(spark, sf_dir)), _longest, "doc_id long, page int, seq int, text string"),
}

"""Literal documents with known answers."""

import json

import pandas as pd
from pyspark.sql import functions as F

from pagewright.operators import run_on_blocks
from pagewright.operators.extras import _leaders, clean_block, similarity
from pagewright.operators.models import synthetic_blocks
from pagewright.sources import read_trees, tree_blocks, tree_spans
from pagewright.streaming import outline_stream

SCHEMA = "doc_id long, seq int, page int, text string, font_size double, is_bold boolean, is_italic boolean, x0 double, y0 double, x1 double, y1 double"


def blocks(spark, rows):
    """rows: (text, size, bold, page), one document."""
    return spark.createDataFrame([(1, i, p, t, float(s), b, False, 72.0, 80.0 * i, 300.0, 80.0 * i + s) for i, (t, s, b, p) in enumerate(rows)], SCHEMA)


def test_outline(spark):
    df = blocks(spark, [("Annual Report Overview", 20, True, 0), ("Summary", 16, True, 0), ("Body text of the report.", 10, False, 0), ("1. Project Plan Details Of Work", 12, False, 1), ("2.1 Scope Of Work", 12, False, 1)])
    got = [(r.level, r.text, r.page) for r in run_on_blocks("outline_headings", df).orderBy("pos").collect()]
    assert got == [("H1", "Annual Report Overview", 1), ("H2", "Summary", 1), ("H2", "1. Project Plan Details Of Work", 2), ("H3", "2.1 Scope Of Work", 2)]
    assert run_on_blocks("document_title", df).first().title == "Annual Report Overview"


def test_noise(spark):
    texts = ["1. Introduction", "Summary:", "1.", "5 6", "date", "Page 3", "3 of 9", "March 2003 7", "Intro....... 5", "www.x.org", "Copyright x", "January 5, 2024", "Total annual $5M $6M", "4. PAY + SI + NPA", "A Real Heading"]
    got = {r.seq: r.noise for r in run_on_blocks("noise_flags", blocks(spark, [(t, 12, False, 0) for t in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * 13 + [False, False]


def test_language(spark):
    texts = ["第1章 概要", "第１章 概要", "概述 第2节", "한국어", "Größe", "Straße", "año", "résumé", "Chapter one"]
    got = {r.seq: r.language for r in run_on_blocks("block_language", blocks(spark, [(t, 12, False, 0) for t in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == ["japanese", "japanese", "chinese", "korean", "french", "german", "spanish", "french", "english"]


def test_dedup_order(spark):
    rows = [("Header X", 12, False, p) for p in range(4)] + [(f"Unique body {k} here", 12, False, k) for k in range(4)]
    df = blocks(spark, rows)
    assert [r.text for r in run_on_blocks("block_dedup", df).collect()].count("Header X") == 1
    assert "Header X" not in [r.text for r in run_on_blocks("repeated_effective", df).collect()]


def test_empty(spark):
    df = blocks(spark, [("x", 12, False, 0)]).limit(0)
    for name in ("outline_headings", "result_document", "rule_combined", "title_best", "header_footer_filter"):
        assert run_on_blocks(name, df).count() == 0


def test_trees(spark, tmp_path):
    span = {"text": "Deep", "size": 14.0, "flags": 18, "font": "Arial", "bbox": [1.0, 2.0, 3.0, 4.0]}
    tree = {"doc_id": 7, "pages": [{"blocks": [{"lines": [{"spans": [span, {**span, "text": "Title", "size": 20.0}]}]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    trees = read_trees(spark, str(tmp_path / "t.json"))
    assert tree_spans(trees).where("is_bold and is_italic").count() == 2
    row = tree_blocks(trees).first()
    assert (row.text, row.font_size, row.is_bold) == ("Deep Title", 20.0, True)


def test_cleaning(spark):
    texts = ["Reeeequest", "R F P title", "abcabcabcabc", "a  b   c", "w o r d here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", clean_block(F.col("t")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == ["Request", "RFP title", "abc", "a b c", "word here"]


def test_leaders():
    rows = [(1, p, p * 8, "header", "confidential draft") for p in range(4)] + [(1, 0, 1, "header", "once only here")]
    out = _leaders(pd.DataFrame(rows, columns=["doc_id", "page", "seq", "kind", "text"]))
    assert out[["text_pattern", "n_pages"]].values.tolist() == [["confidential draft", 4]]
    assert similarity("page 1", "page 1 of 3") == 0.8 and similarity("", "x") == 0.0


def test_synthetic(spark):
    rows = synthetic_blocks(spark, 500).collect()
    assert len(rows) == 500 and 120 < sum(r.label == "heading" for r in rows) < 280


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "First Heading\nbody of the text here and more\n"), (2, "Second Heading\nanother body of the text, long enough to count\n")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    outline_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 2

"""Models, sinks and page functions on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import models, run
from pagewright.operators.extras import _longest, layout_objects, leader_groups, process_pages, result_records
from pagewright.sources import read_training, valid_files, write_debug, write_outlines, write_reports, write_training


@pytest.fixture(scope="module")
def rows(spark):
    """Two informative features, the others noise."""
    noise = [f"rand({k}) AS {f}" for k, f in enumerate(models.FEATURES) if f not in ("font_size_ratio", "word_count")]
    df = spark.range(600).selectExpr("id AS doc_id", "0 AS seq", "cast(id % 3 = 0 AS double) AS label", "cast(id % 3 = 0 AS double) + 0.2 * rand(90) AS font_size_ratio", "cast(id % 3 AS double) + rand(91) AS word_count", "12.0D AS font_size", *noise)
    return df.cache()


@pytest.mark.parametrize("kind", ["forest", "boosting", "logistic"])
def test_train_save_load_predict(rows, spark, tmp_path, kind, monkeypatch):
    if kind == "boosting":
        short = models.pipeline
        monkeypatch.setattr(models, "pipeline", lambda k="forest", f=None: (p := short(k, f), p.getStages()[2].setMaxIter(3))[0])
    model = models.train(rows, kind)
    models.save_model(model, str(tmp_path / "m"))
    got = models.predict(models.load_model(str(tmp_path / "m")), rows).join(rows.select("doc_id", "label"), "doc_id")
    assert got.count() == 600 and got.where("is_heading <> (label = 1)").count() < 12
    assert models.predict(None, rows).where("is_heading or probability <> 0.1").count() == 0


def test_cross_validation_and_grid(rows):
    folds = models.cross_validate(rows)
    assert folds.count() == 5 and all(r.f1 > 0.95 for r in folds.collect())
    summary = {r.metric: r for r in models.cross_validation_summary(folds).collect()}
    f1 = [r.f1 for r in folds.collect()]
    assert abs(summary["f1"].mean - np.mean(f1)) < 1e-9 and abs(summary["f1"].deviation - np.std(f1)) < 1e-9
    got = models.grid_search(rows, "logistic", [{"regParam": 100.0, "elasticNetParam": 1.0}, {"regParam": 0.01, "elasticNetParam": 0.0}]).collect()
    assert json.loads(got[0].settings)["regParam"] == 0.01 and got[0].f1 > got[1].f1
    assert {k: len(x) for k, x in models.grids().items()} == {"forest": 27, "boosting": 27, "logistic": 8}


def test_selection(rows):
    top = models.mutual_information(rows).orderBy(F.desc("information")).limit(2).collect()
    assert {r.feature for r in top} == {"font_size_ratio", "word_count"} and abs(top[0].information - 0.6365) < 0.01
    assert {"font_size_ratio", "word_count"} <= set(models.select_features(rows, 12))
    groups = models.feature_groups(["font_size", "rule_confidence", "whitespace_before"])
    assert groups["font"] == ["font_size"] and groups["rule"] == ["rule_confidence"] and groups["context"] == ["whitespace_before"]


def test_training_variants(rows, spark):
    assert models.multilingual_blocks(spark, 50).groupBy("language").count().count() == 5
    model = models.train_from_synthetic(spark, "logistic", 300, 50)
    made = models._as_rows(models.synthetic_blocks(spark, 300, seed=5).select("id", "text", "page", "font_size", "is_bold", "x0", "label"))
    assert made.join(models.predict(model, made), ["doc_id", "seq"]).where("is_heading = (label = 1)").count() > 240
    assert models.predict(models.train_from_real(rows, 100, "logistic"), rows).count() == 600
    assert models.predict(models.lightweight_model(rows), rows).where("probability > 0.5").count() > 150
    p = models.with_probability(rows.select("doc_id", "seq", "word_count"), models.predict(None, rows)).first()
    assert (p.ml_heading_probability, round(p.ml_confidence, 6)) == (0.1, 0.8)


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"threshold": 0.7}')
    assert models.read_config(str(tmp_path / "c.json"))["threshold"] == 0.7
    with pytest.raises(ValueError):
        models.configured({"nothing": 1})


def test_training_from_the_command_line(spark, tmp_path):
    from pagewright.operators.training import main

    got = main(["--synthetic", "300", "--model", "logistic", "--folds", "3", "--out", str(tmp_path / "m")], spark)
    assert set(got) == {"accuracy", "precision", "recall", "f1"} and got["accuracy"] > 0.8 and models.load_model(str(tmp_path / "m"))


def test_records_and_layout_objects(spark):
    docs = spark.createDataFrame([(2, "Executive Summary\nplain words of a body line that is long enough not to be a heading at all, as it goes on\n")], "doc_id long, text string")
    r = result_records(docs).first()
    assert (r.doc_id, r.outline[0].text, r.outline[0].page, r.metadata.detected_language) == (2, "Executive Summary", 1, "english")
    tables = spark.createDataFrame([(2, 0, 3, 4, 10.0, 50.0, 90.0, 80.0), (2, 0, 1, 1, 10.0, 20.0, 90.0, 30.0)], "doc_id long, page int, rows int, cols int, x0 double, y0 double, x1 double, y1 double")
    both = layout_objects(run("layout_rectangles", docs), tables).collect()
    assert [(x.id, x.rows) for x in both if x.type == "table"] == [("table_0", 1), ("table_1", 3)] and all(x.height > 30 for x in both if x.type == "rectangle")


def test_clusters(spark):
    docs = spark.createDataFrame([(2, "\n".join(["Big Title"] + [f"this is a longer line of plain body text number {k} with many words in it" for k in range(12)]))], "doc_id long, text string")
    found = models.font_clusters(docs)
    profiles = models.cluster_profiles(run("block_scan", docs), found).collect()
    assert sum(p.size for p in profiles) == found.count() == 13 and all(p.sample_texts for p in profiles)
    s = models.cluster_statistics(models.cluster_profiles(run("block_scan", docs), found)).first()
    assert s.total_clusters == len(profiles) == s.heading_clusters + s.text_clusters


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "A", 12.0, "heading"), (1, 1, "b", 10.0, "text"), (2, 0, "C", 9.0, "text")], "doc_id long, seq int, text string, font_size double, label string")
    write_training(rows, str(tmp_path / "t"))
    back = read_training(spark, str(tmp_path / "t"))
    assert sorted((r.doc_id, r.seq, r.text, r.label) for r in back.collect()) == [(1, 0, "A", "heading"), (1, 1, "b", "text"), (2, 0, "C", "text")]
    write_outlines(rows, str(tmp_path / "o"))
    write_debug(rows.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "d"))
    assert "none" in spark.read.json(str(tmp_path / "d")).columns and spark.read.json(str(tmp_path / "o")).count() == 3
    write_reports(spark.createDataFrame([(1, "x\ny")], "doc_id long, report string"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["x", "y"]
    for name, n in (("a.pdf", 3), ("B.PDF", 5), ("c.txt", 1)):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"x" * n)
    assert sorted(r.path.rpartition("/")[2] for r in valid_files(spark, str(tmp_path / "f")).collect()) == ["B.PDF", "a.pdf"]


def test_pages_and_leaders(spark):
    docs = spark.createDataFrame([(3, "\n".join(f"line {k} of the text" for k in range(40)))], "doc_id long, text string")
    longest = process_pages(run("block_scan", docs), _longest, "doc_id long, page int, seq int, text string").collect()
    scanned = run("block_scan", docs).toPandas()
    assert {r.page: len(r.text) for r in longest} == scanned.groupby("page").text.apply(lambda x: x.str.len().max()).to_dict()
    # the fold in Python and the one in SQL agree
    sql = {(r.kind, r.text_pattern, r.n_pages) for r in run("header_footer_groups", docs).collect()}
    assert {(r.kind, r.text_pattern, r.n_pages) for r in leader_groups(docs).collect()} == sql and sql

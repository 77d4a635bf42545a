"""Held-out scores are of all rows, not of the rows that a model may be fitted on."""

from pagewright.operators import models


def test_every_held_out_row_is_scored(spark, monkeypatch):
    df = spark.range(400).selectExpr("id AS doc_id", "0 AS seq", "cast(id % 2 AS double) AS label", *[f"cast(id % 2 AS double) + rand({k}) AS {f}" for k, f in enumerate(models.FEATURES)]).cache()
    seen = []
    real = models._metrics
    monkeypatch.setattr(models, "_metrics", lambda rows: seen.append(rows.count()) or real(rows))
    assert models.cross_validate(df, limit=100).count() == models.FOLDS and sum(seen) == 400

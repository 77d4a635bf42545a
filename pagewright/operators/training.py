"""Training from the command line: python -m pagewright.operators.training --documents PATH --model forest --out PATH"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ..sources import read_training
from . import models


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    """Trains from documents, from a training file's labels or from generated blocks, saves the model and prints the metrics."""
    options = argparse.ArgumentParser()
    source = options.add_mutually_exclusive_group(required=True)
    source.add_argument("--documents", help="Parquet of doc_id, text")
    source.add_argument("--training", help="training file; its rows have the feature columns")
    source.add_argument("--synthetic", type=int, help="number of generated blocks")
    options.add_argument("--model", choices=["forest", "boosting", "logistic", "light"], default="forest")
    options.add_argument("--out", required=True)
    options.add_argument("--folds", type=int, default=models.FOLDS)
    given = options.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.documents:
        rows = models.training_blocks(spark.read.parquet(given.documents))
    elif given.training:
        rows = read_training(spark, given.training).selectExpr("*", "cast(label = 'heading' AS double) AS y").drop("label").withColumnRenamed("y", "label")
    else:
        rows = models._as_rows(models.synthetic_blocks(spark, given.synthetic).select("id", "text", "page", "font_size", "is_bold", "x0", "label"))
    model = models.lightweight_model(rows) if given.model == "light" else models.train(rows, given.model)
    models.save_model(model, given.out)
    kind = "forest" if given.model == "light" else given.model
    found = {r["metric"]: r["mean"] for r in models.cross_validation_summary(models.cross_validate(rows, kind, given.folds)).collect()}
    print(json.dumps(found))
    return found


if __name__ == "__main__":
    main()

"""Continuous extraction: documents that land in a folder are outlined batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import run


def outline_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, plan: str = "outline_headings", once: bool = False) -> StreamingQuery:
    """Reads Parquet documents(doc_id, text) as they arrive and appends the plan's rows under out; each document is in one file."""

    def each(batch: DataFrame, batch_id: int) -> None:
        run(plan, batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows = spark.readStream.schema("doc_id long, text string").parquet(landing)
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

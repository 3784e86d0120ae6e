"""The per-note operators over a stream: they keep no state, so a stream of records is processed as a table is."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from siloflow.operators import extraction, pii
from siloflow.sources.notes import INPUT_SCHEMA


def deidentify_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Read records (JSON lines) that arrive in a folder; write spans, rendered text and extracted fields as Parquet, each record once."""
    notes = spark.readStream.schema(INPUT_SCHEMA).json(source)
    done = extraction.extract(pii.deidentified(pii.detect(notes.withColumn("_age", notes["structured_features.age_years"]), age="_age"))).drop("_age")
    writer = done.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

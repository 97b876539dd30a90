"""Stylesheets over streams: a transform keeps no state between documents, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.api import Transformer


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, xml string") -> DataFrame:
    """New Parquet files of documents as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def transform_stream(source: DataFrame, transformer: Transformer, sink: str, checkpoint: str):
    """Writes each document's result once as Parquet; returns the running query."""
    return transformer.transform(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").start()

"""Session settings that the plans count on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # A table dealt by doc_id serves joins and windows on doc_id and more without another exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def written_once(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names (a temporary one only where that is unset): what is dear to make is made once, and a lost executor costs nothing."""
    import tempfile

    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="sylvan-")
    path = f"{top.rstrip('/')}/sylvan/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

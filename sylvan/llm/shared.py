"""Lineage cuts in the folder that all executors share, and small helpers for input columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or unset()).rstrip("/")


@cache
def unset() -> str:
    return tempfile.mkdtemp(prefix="sylvan-")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sylvan/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to about BATCH bytes (one row at least), so that executors and workers hold little at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)

"""Structured Streaming intake: new record files are normalised as they arrive, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import enrich
from recordloom.sources.tsv import ENTITY

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ENTITY])


def read_records(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the tab-separated record files of a folder; nulls are empty strings."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).csv(folder, sep="\t", header=True, quote="\u0000", escape="\u0000")
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ENTITY])


def intake(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Start a query that appends the normalised records to a Parquet store, by country."""
    return (
        enrich(read_records(spark, folder)).writeStream.format("parquet").partitionBy("country")
        .option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )

"""Parquet stores of entities and pairs, row-count audits and settings fingerprints."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_entities(entities: DataFrame, path: str) -> None:
    """Partitioned by country and side, so that a query of one country reads one folder."""
    side = F.when(F.col("src") == "S1", "E1").otherwise("E2")
    entities.withColumn("side", side).write.mode("overwrite").partitionBy("country", "side").parquet(path)


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all runs on one machine, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from the table, and lost executors cost their tasks only."""
    path = f"{shared_dir(df.sparkSession)}/recordloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def audit(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """name, n_rows, n_expected, ok of each expected table; a missing one has no rows and is not ok."""
    want = spark.createDataFrame(sorted(expected.items()), "name string, n_expected bigint")
    have = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        have = row if have is None else have.unionByName(row)
    joined = want.join(have, "name", "left") if have is not None else want.withColumn("n_rows", F.lit(None).cast("bigint"))
    return joined.select("name", "n_rows", "n_expected", F.coalesce(F.col("n_rows") == F.col("n_expected"), F.lit(False)).alias("ok"))


def conserved(source: DataFrame, processed: DataFrame, by: str = "src") -> DataFrame:
    """Groups whose row counts differ between the two; empty when no row was lost or made."""
    a = source.groupBy(by).agg(F.count(F.lit(1)).alias("n_source"))
    b = processed.groupBy(by).agg(F.count(F.lit(1)).alias("n_processed"))
    return a.join(b, by, "full").fillna(0, ["n_source", "n_processed"]).where("n_source <> n_processed")


def fingerprint(settings: dict) -> str:
    """A digest of settings: equal settings give equal digests in any order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()

"""Tables and small aggregates that the operators keep in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"


_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of texts and sets small enough for two workers in a small executor; the session's own settings come back."""
    old = {k: spark.conf.get(k) for k in _BATCHES}
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def forget(*kept: DataFrame) -> None:
    """Delete tables made by keep() that no later plan reads."""
    for df in kept:
        path = getattr(df, "_kept_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bitmap(df: DataFrame, column: str, log2_bits: int = 23) -> np.ndarray:
    """A one-hash Bloom filter of a bigint column as uint64 words.

    The size is fixed by log2_bits (1 MB at 23), whatever the number of rows, so it may be broadcast.
    Test values with textkit.in_bitmap(); false positives must be removed by an exact join afterwards.
    """
    spread = F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = (
        df.select(spread.alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def with_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", log2_bits: int = 23, then=None, schema: str | None = None) -> DataFrame:
    """The rows of df whose id is in ids (a column of the same name), and perhaps a few more.

    ids becomes a bitmap of fixed size, so that the wide rows of df need not be shuffled to be screened;
    an exact join must follow. Rows without an id go. then, a function of batches with the given schema, sees what is
    left in the same worker: two mapInArrow() in a row would keep two workers for each core.
    """
    from .textkit import in_bitmap

    shared = df.sparkSession.sparkContext.broadcast(bitmap(ids.select(column).where(F.col(column).isNotNull()), column, log2_bits))

    def some(batches):
        for b in batches:
            there = b.column(column).is_valid().to_numpy(zero_copy_only=False)
            hit = in_bitmap(shared.value, b.column(column).fill_null(0).to_numpy())
            yield b.filter(pa.array(hit & there))

    return df.mapInArrow((lambda batches: then(some(batches))) if then else some, schema or df.schema)

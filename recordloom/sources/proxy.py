"""Business records derived from the test tables, which hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country of every document.

    The id's first two characters are the source (S1 where doc_id % 4 = 0, else S2 or S3 by doc_id % 2); the
    name is the text's first five words, the address a number and the words after them.
    """
    w = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\r\x0B\f]", " "), " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    src = F.when(F.col("doc_id") % 4 == 0, "S1").when(F.col("doc_id") % 2 == 0, "S2").otherwise("S3")
    return table(spark, sf_dir, "documents").select(
        F.concat(src, F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("entity_id"),
        part(1, 5).alias("business_name"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" "), part(6, 3), F.lit(", "), part(9, 2), F.lit(", "), "source").alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id1, id2 of equal texts across the two sides within a country."""
    r = records(spark, sf_dir).select("entity_id", "country")
    key = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), F.col("doc_id"))
    ids = r.withColumn("doc_id", F.substring("entity_id", 4, 10).cast("bigint")).join(key, "doc_id").where("h is not null")
    one = ids.where("entity_id like 'S1%'").select("country", "h", F.col("entity_id").alias("id1"))
    two = ids.where("entity_id not like 'S1%'").select("country", "h", F.col("entity_id").alias("id2"))
    return one.join(two, ["country", "h"]).select("id1", "id2")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, id, vec of the embeddings, as one country."""
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("country"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")

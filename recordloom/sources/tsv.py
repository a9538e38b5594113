"""Tab-separated tables without quoting: every value is a string, an empty one is not null."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ENTITY = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def read_tsv(spark: SparkSession, path: str, columns: list[str] = ENTITY) -> DataFrame:
    """columns: those of the file, in its order. Bad UTF-8 becomes U+FFFD."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, sep="\t", header=True, quote="\u0000", escape="\u0000", schema=schema).na.fill("")


def write_tsv(df: DataFrame, path: str) -> None:
    """One line for each row, in the order of the frame, with a header; no quoting."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def write_json(value: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f, indent=1)


def find_data_dir(root: str, name: str = "train_source1.tsv") -> str:
    """The first folder under root that holds a file of this name."""
    for folder, inner, files in os.walk(root):
        inner.sort()
        if name in files:
            return folder
    raise FileNotFoundError(f"no {name} under {root}")

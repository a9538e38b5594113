"""Token counts of texts through a cache of content digests."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import exists, keep, new_path
from .tokens import encoder

CACHE = "content binary, tokenizer string, n_bytes bigint, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of a vocabulary file: another version of it never meets this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str, tokenizer: str):
    def run(batches):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            count = lambda texts: [len(x) // 4 for x in encoder(path).encode(texts)]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                n = count(part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("content"), pa.array([tokenizer] * part.num_rows), part.column("n_bytes"), pa.array(n, pa.int64())],
                    ["content", "tokenizer", "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, cache_path: str, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of docs.

    path: a vocabulary file, .json for tokenizers or .model for sentencepiece; no begin or end tokens.
    cache_path: a Parquet table of counts by content digest and tokenizer digest, or a path where none is
    yet. Normalised content is the whole text with null as empty; its SHA-256 is joined with the cache,
    one text of each missing digest is encoded, and the new counts are appended to the cache, so a later
    call encodes only what it has not seen. An empty table gives no rows; repeated rows and ids each get
    their row; long texts are encoded whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(path)
    body = F.coalesce(F.col("text"), F.lit(""))
    full = docs.select("doc_id", body.alias("body")).withColumn("content", F.unhex(F.sha2("body", 256))).withColumn("n_bytes", F.octet_length("body").cast("bigint"))
    rows = keep(full.select("doc_id", "content", "n_bytes"), "contents")
    there = exists(spark, cache_path)
    read = lambda: spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
    todo = full.join(read().select("content"), "content", "left_anti") if there else full
    new = todo.select("content", "n_bytes", "body").dropDuplicates(["content"])
    new.mapInArrow(_counter(path, tokenizer), CACHE).write.mode("append").parquet(cache_path)
    counts = read().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, new_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))

"""Exact deduplication of a batch against an immutable snapshot, screened by binary fuse filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import exists, keep, lower_az, new_path, with_ids

_U = np.uint64
SHARD_KEYS = 1 << 17
"""Mean number of digests behind one filter; it bounds the memory of a task that builds or probes one."""


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.int64).view(_U) + _U(seed)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """The three slots of each hash: neighbouring segments, as in Graf and Lemire (2022)."""
    first = (((h >> _U(32)) * _U(count * segment)) >> _U(32)).astype(np.int64)
    mask = segment - 1
    return np.stack(
        [
            first,
            (first + segment) ^ ((h >> _U(18)).astype(np.int64) & mask),
            (first + 2 * segment) ^ (h.astype(np.int64) & mask),
        ]
    )


def _print8(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A 3-wise binary fuse filter with 8-bit fingerprints over distinct int64 keys: (seed, segment length,
    segment count, fingerprints). Peels all keys that are alone in a slot at once, round by round."""
    n = len(keys)
    segment = 4 if n < 2 else min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
    factor = 0.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    for attempt in range(100):
        count = max(1, math.ceil(n * factor * (1 + attempt // 20 * 0.1) / segment) - 2)
        size = (count + 2) * segment
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & ((1 << 64) - 1)
        h = _mix(keys, seed)
        slots = _slots(h, segment, count)
        alive, order = np.arange(n), []
        while len(alive):
            live = slots[:, alive]
            degree = np.bincount(live.ravel(), minlength=size)
            single = degree[live] == 1
            free = single.any(axis=0)
            if not free.any():
                break
            which = single.argmax(axis=0)[free]
            order.append((alive[free], which))
            alive = alive[~free]
        if not len(alive):
            table = np.zeros(size, np.uint8)
            for who, which in reversed(order):
                own = slots[which, who]
                value = _print8(h[who]) ^ table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]]
                table[own] = value ^ table[own]
            return seed, segment, count, table.tobytes()
    raise RuntimeError("no seed gives a peelable filter")


def fuse_contains(keys: np.ndarray, seed: int, segment: int, count: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the filter: never false for a key it was built from."""
    t = np.frombuffer(table, np.uint8)
    h = _mix(keys, seed)
    s = _slots(h, segment, count)
    return _print8(h) == t[s[0]] ^ t[s[1]] ^ t[s[2]]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha (hex SHA-256 of the text with A-Z lower-cased, null as empty) and its 64-bit key."""
    sha = F.sha2(lower_az(F.col("text")), 256)
    return docs.select("doc_id", sha.alias("sha")).withColumn("key", F.xxhash64("sha"))


_BUCKETS = "sha string, key bigint, shard int, last bigint, n bigint"
_FILTERS = "shard int, shards int, seed bigint, segment int, segments int, fingerprints binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, count, table = fuse_build(pdf["key"].unique())
    one = pdf[["shard", "shards"]].iloc[:1].reset_index(drop=True)
    return one.assign(seed=np.uint64(seed).astype(np.int64), segment=segment, segments=count, fingerprints=[table])


def stored_snapshot(digest_rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(exact buckets, filters, number of shards) of an immutable snapshot, read from path; written there first if absent.

    Buckets: sha, key, shard, last (largest doc_id), n. Filters: one row per shard. path belongs to this
    snapshot alone; the filters are written last, so what a failed run left is written again.
    """
    spark = digest_rows.sparkSession
    buckets = spark.read.schema(_BUCKETS)
    if not exists(spark, f"{path}/filters/_SUCCESS"):
        shards = max(1, -(-digest_rows.count() // SHARD_KEYS))
        once = digest_rows.groupBy("sha", "key").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        once.select("sha", "key", F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "last", "n").write.mode("overwrite").parquet(f"{path}/buckets")
        keys = buckets.parquet(f"{path}/buckets").select("shard", F.lit(shards).alias("shards"), "key")
        keys.groupBy("shard").applyInPandas(_build, _FILTERS).write.mode("overwrite").parquet(f"{path}/filters")
    filters = spark.read.schema(_FILTERS).parquet(f"{path}/filters")
    return buckets.parquet(f"{path}/buckets"), filters, filters.agg(F.max("shards")).first()[0] or 1


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of batch (sha, key, shard; distinct digests) that a filter of their shard may hold."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return left.iloc[:0][["sha"]]
        f = right.iloc[0]
        hit = fuse_contains(left["key"].to_numpy(), int(f["seed"]) & ((1 << 64) - 1), int(f["segment"]), int(f["segments"]), f["fingerprints"])
        return left.loc[hit, ["sha"]]

    return batch.select("sha", "key", "shard").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "sha string")


def exact_dedup(snapshot: DataFrame, incoming: DataFrame, path: str | None = None) -> DataFrame:
    """Groups of equal texts over a snapshot and a new batch, both with doc_id bigint and text.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Returns one row per
    row of both: doc_id, keep_id (largest doc_id of the group), group_size, kept, text_sha256, incoming.
    The snapshot's distinct digests are sharded, each shard gets a static binary fuse filter; buckets and
    filters are stored under path (or a new one) and read again by later batches that name it. The batch is
    grouped by digest by itself; its distinct digests are screened by the filters, and only positives are
    joined with the exact buckets, where the texts are compared byte by byte; a batch group that passes
    joins the snapshot's group, any other stays a group of the batch.
    Empty tables give no rows. A repeated doc_id counts as often as it stands there, each with the same
    verdict; a row whose doc_id is null counts in group_size and is never kept. Other columns are ignored.
    """
    rows = keep(
        digests(snapshot).withColumn("incoming", F.lit(False)).unionByName(digests(incoming).withColumn("incoming", F.lit(True))),
        "digests",
    )
    buckets, filters, shards = stored_snapshot(rows.where("not incoming"), path or new_path(rows.sparkSession, "snapshot"))
    batch = (
        rows.where("incoming").groupBy("sha", "key").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    )
    met = keep(
        screen(batch, filters).join(batch.select("sha", "key", F.col("last").alias("new_id")), "sha")
        .join(buckets.select("sha", F.col("last").alias("old_id")), "sha"),
        "positives",
    )
    both = snapshot.select("doc_id", "text").unionByName(incoming.select("doc_id", "text")).select("doc_id", lower_az(F.col("text")).alias("t"))
    named = with_ids(both, met.select(F.explode(F.array("new_id", "old_id")).alias("doc_id")))
    nameless = with_ids(both.where("doc_id is null").withColumn("key", F.xxhash64(F.sha2("t", 256))), met, "key")
    texts = named.select("t").union(nameless.select("t")).groupBy(F.sha2("t", 256).alias("sha")).agg(F.min("t").alias("x"), F.max("t").alias("y"))
    same = texts.where("x = y").join(met.select("sha"), "sha").select("sha", F.lit(True).alias("joined"))
    sides = buckets.select("sha", "last", "n", F.lit(False).alias("incoming")).unionByName(
        batch.select("sha", "last", "n", F.lit(True).alias("incoming"))
    )
    groups = (
        sides.join(same, "sha", "left")
        .withColumn("part", F.when(F.col("joined"), F.lit(2)).otherwise(F.col("incoming").cast("int")))
        .groupBy("sha", "part").agg(F.max("last").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("incoming").alias("sides"))
        .select("sha", "keep_id", "group_size", F.explode("sides").alias("incoming"))
    )
    return rows.join(groups, ["sha", "incoming"]).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"), "incoming",
    )


def op5_exact_dedup(spark, sf_dir):
    """Every document; by a hash of doc_id, half of the rows stand as the snapshot and half as the new batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    new = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(True))
    return exact_dedup(docs.where(~new), docs.where(new)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_OP5 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), false) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""

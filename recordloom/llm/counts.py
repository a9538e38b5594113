"""Count vectors of fixed size over a whole table, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 16
_SCHEMA = "block int, counts binary"


def fixed_counts(df: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Sum over all rows of what count(batch, vector) adds to an int64 vector of the given size.

    Each partition sends its vector once, compressed, in blocks that are added up by tasks; the driver gets
    the sum, whose size does not depend on the rows.
    """
    import zstandard

    def local(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            count(b, total)
        if total.any():
            press = zstandard.ZstdCompressor(level=1)
            bodies = [press.compress(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes()) for p in np.array_split(total, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(bodies, pa.binary())], ["block", "counts"])

    def add(key, table):
        total = None
        for body in table.column("counts"):
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)
            part = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()
            total = part if total is None else total + part
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    got = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in df.mapInArrow(local, _SCHEMA).groupBy("block").applyInArrow(add, _SCHEMA).collect()}
    return np.concatenate([got[k] for k in range(BLOCKS)]) if got else np.zeros(size, np.int64)


def labelled_sample(labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` doc_ids, sorted, and their labels: the first by a hash of doc_id.

    A doc_id with several labels takes the smallest; null ids and labels are left out.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    )
    rows = rows.sort_values("doc_id")
    return rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy()


def find(ids: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
    """Place of each row's doc_id in sorted ids, -1 where it is not there."""
    if not len(ids):
        return np.full(b.num_rows, -1, np.int64)
    column = b.column("doc_id")
    there = column.is_valid().to_numpy(zero_copy_only=False)
    x = column.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where((ids[at] == x) & there, at, -1)


def top_k(df: DataFrame, k: int, score: str, tie: str):
    """A condition true for the k rows of largest score (bigint), ties by smallest tie (bigint).

    Finds the cut by counting rows in ever narrower ranges, so no row is sorted or gathered. Differences of
    values must fit a bigint. Rows equal in both come in together; null scores or ties never come in.
    """

    def cut(rows: DataFrame, column: str, k: int) -> tuple[int, int] | None:
        """(value v, rows above v) such that the rows above v number k at most, those from v on k at least."""
        ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        if ends["lo"] is None:
            return None
        lo, hi, above = ends["lo"], ends["hi"], 0
        while True:
            width = max(1, -(-(hi - lo + 1) // 1024))
            seen = (
                rows.where(F.col(column).between(lo, hi)).groupBy(F.floor((F.col(column) - lo) / width).cast("int").alias("bin"))
                .agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("bin")).collect()
            )  # 1024 rows at most
            last = seen[-1]["bin"]
            for r in seen:
                if above + r["m"] >= k or r["bin"] == last:
                    break
                above += r["m"]
            lo, hi = lo + r["bin"] * width, min(hi, lo + (r["bin"] + 1) * width - 1)
            if lo == hi:
                return lo, above

    rows = df.where(F.col(score).isNotNull() & F.col(tie).isNotNull())
    found = cut(rows, score, k) if k > 0 else None
    if found is None:
        return F.lit(False)
    value, above = found
    level = rows.where(F.col(score) == value).withColumn("_t", -F.col(tie))
    last = cut(level, "_t", k - above)
    return F.col(tie).isNotNull() & F.coalesce((F.col(score) > value) | ((F.col(score) == value) & (-F.col(tie) >= last[0])), F.lit(False))

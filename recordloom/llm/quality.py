"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The raw model counts hashed words, word beginnings and word pairs of all rows, plus one in each bucket. The
target model counts those of the target rows, with PRIOR occurrences spread as the raw model has them. A
text's weight is log p_target - log p_raw of all its n-grams; the sample without replacement takes the rows of
largest weight + Gumbel noise (Gumbel top-k: draws proportional to p_target / p_raw).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import find, fixed_counts, labelled_sample, top_k
from .store import keep
from .textkit import groups, mix

SIZE = 1 << 18
"""Hash buckets of words, word beginnings and word pairs."""
BEGINNING = 6
"""Bytes of a word that are an n-gram of their own."""
PRIOR = 1 << 18
"""Occurrences, spread as in the raw model, that smooth the target model: one for each bucket on average."""
LABELLED = 1 << 17
"""Most labelled documents that the target model is fitted on."""
SHARE = 0.75
"""Share of the rows that is sampled."""
_U = np.uint64


def _grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of words, word beginnings and pairs of neighbours; owner text of each). h: words and beginnings."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    two = mix(h[pair, 0] * _U(3) + h[pair + 1, 0])
    start = mix(h[:, 1] + _U(7))
    return (np.concatenate([h[:, 0], start, two]) & _U(SIZE - 1)).astype(np.int64), np.concatenate([owner, owner, owner[pair]])


def _models(shared):
    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        target = find(shared.value, b) >= 0
        for lo, hi, h, bounds in groups(b.column("text"), (BEGINNING,)):
            at, owner = _grams(h, bounds)
            total[:SIZE] += np.bincount(at, minlength=SIZE)
            total[SIZE:] += np.bincount(at[target[lo:hi][owner]], minlength=SIZE)

    return count


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from the counts of all rows and of the target rows."""
    p_raw = (raw + 1.0) / (raw.sum() + len(raw))
    p_target = (target + PRIOR * p_raw) / (target.sum() + PRIOR)
    return np.log(p_target) - np.log(p_raw)


def _weigh(shared):
    def run(batches):
        ratio = shared.value
        for b in batches:
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lo, hi, h, bounds in groups(b.column("text"), (BEGINNING,)):
                at, owner = _grams(h, bounds)
                n[lo:hi] += np.bincount(owner, minlength=hi - lo)
                weight[lo:hi] += np.bincount(owner, weights=ratio[at], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(weight)], ["doc_id", "n_grams", "log_weight"])

    return run


def gumbel(doc_id):
    """Gumbel noise of an id, from a uniform number in (0, 1) of 52 bits of its hash."""
    u = (F.xxhash64(doc_id, F.lit("gumbel")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, target_ids: np.ndarray, share: float = SHARE) -> DataFrame:
    """docs (doc_id bigint, text) -> doc_id, n_grams, log_weight, score, per_gram, kept; one row per row.

    log_weight: log p_target - log p_raw of the text (see above; target: the rows whose doc_id is in target_ids).
    score: log_weight + Gumbel(doc_id), by which the round(share * rows) largest are kept, to six decimals, ties
    by doc_id. per_gram: log_weight / n_grams, which does not depend on a text's length, for reports only.
    Null and wordless texts have weight 0. A null doc_id is never kept; rows that repeat a doc_id have the same
    noise, and those that are also equal in score come in together, so the sample may exceed its size by them.
    An empty table gives no rows; without target rows all weights are 0. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    total = fixed_counts(docs, 2 * SIZE, _models(sc.broadcast(target_ids)))
    ratio = log_ratios(total[:SIZE].astype(float), total[SIZE:].astype(float))
    weights = docs.mapInArrow(_weigh(sc.broadcast(ratio)), "doc_id bigint, n_grams bigint, log_weight double")
    score = F.col("log_weight") + gumbel("doc_id")
    rows = keep(weights.withColumn("score", score).withColumn("place", F.round(score * 1e6).cast("bigint")), "weights")
    kept = top_k(rows, round(share * rows.count()), "place", "doc_id")
    per_gram = F.col("log_weight") / F.greatest("n_grams", F.lit(1))
    return rows.select("doc_id", "n_grams", "log_weight", "score", per_gram.alias("per_gram"), kept.alias("kept"))


def op4_importance_resampling(spark, sf_dir):
    """Target: labelled documents of quality 1 that are not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    ids, is_good = labelled_sample(good, "good", LABELLED)
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids[is_good.astype(bool)])

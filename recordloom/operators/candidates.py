"""Blocking views, the union of candidate passes, and blocking statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.vectors import char_grams

from . import keys, knn

PASSES = ["addr", "both", "key", "name", "rev", "hop"]


def views() -> dict[str, Column]:
    """Texts that candidates are searched by."""
    return {
        "name": F.concat_ws(" | ", "name_core", "name_phon", "domain"),
        "addr": F.col("addr_full"),
        "both": F.concat(F.col("name_core"), F.lit(" | "), F.col("name_phon"), F.lit(" | "), F.col("addr_words"), F.lit(" "), F.col("addr_nums")),
    }


def sides(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source 1, and sources 2 and 3 together."""
    return entities.where("src = 'S1'"), entities.where("src in ('S2', 'S3')")


def tagged(df: DataFrame, name: str) -> DataFrame:
    return df.select("country", "id1", "id2", F.lit(name).alias("pass"), F.col("rank").cast("int"), F.col("sim").cast("double"))


def union_candidates(passes: DataFrame, names: list[str] = PASSES) -> DataFrame:
    """country, id1, id2, pass, rank, sim -> one row for each pair: sim_* (largest), rank_* (smallest), n_passes.

    -1 where a pass did not propose the pair.
    """
    own = lambda n, c: F.when(F.col("pass") == n, F.col(c))
    sims = [F.coalesce(F.max(own(n, "sim")), F.lit(-1.0)).alias(f"sim_{n}") for n in names]
    ranks = [F.coalesce(F.min(own(n, "rank")), F.lit(-1)).alias(f"rank_{n}") for n in names]
    got = passes.groupBy("country", "id1", "id2").agg(*sims, *ranks)
    return got.withColumn("n_passes", reduce(lambda a, b: a + b, [(F.col(f"sim_{n}") > -1).cast("int") for n in names]))


def pivot_candidates(passes: DataFrame, names: list[str]) -> DataFrame:
    """The same as a pivot: null where a pass did not propose the pair, n_passes from the non-null sims."""
    wide = passes.groupBy("country", "id1", "id2").pivot("pass", names).agg(F.max("sim").alias("sim"), F.min("rank").alias("rank"))
    wide = wide.withColumnsRenamed({f"{n}_{c}": f"{c}_{n}" for n in names for c in ("sim", "rank")})
    return wide.withColumn("n_passes", reduce(lambda a, b: a + b, [F.col(f"sim_{n}").isNotNull().cast("int") for n in names]))


def block(entities: DataFrame, cfg) -> DataFrame:
    """All candidate passes of a set of entities, united: views forward and reverse, rare keys, two-hop.

    A country found on one side only has no candidates.
    """
    e1, e2 = sides(entities)
    texts = lambda df, view: df.select("country", F.col("entity_id").alias("id"), views()[view].alias("text"))
    grams = char_grams(F.col("text"))
    made, seeds = [], []
    for view, k in cfg.ks.items():
        forward = knn.topk_text(texts(e1, view), texts(e2, view), grams, k)
        made.append(tagged(forward, view))
        if cfg.rev_k:
            back = knn.reverse(knn.topk_text(texts(e2, view), texts(e1, view), grams, cfg.rev_k))
            made.append(tagged(back, "rev"))
        if view in ("name", "both"):
            seeds.append(forward)
    made.append(tagged(keys.key_candidates(e1, e2, cfg.key_k, cfg.max_df), "key"))
    if cfg.hop_k and seeds:
        search = lambda a, b, k: knn.topk_text(a, b, grams, k)
        hops = knn.self_neighbours(texts(e2, "name"), cfg.hop_k, search)
        made.append(tagged(reduce(DataFrame.unionByName, [knn.two_hop(s, hops) for s in seeds]), "hop"))
    return union_candidates(reduce(DataFrame.unionByName, made))


def blocking_recall(candidates: DataFrame, truth: DataFrame, e1: DataFrame) -> DataFrame:
    """country, found, true_pairs, recall; truth (id1, id2) counts for the country of its id1, reachable or not."""
    own = truth.join(e1.select(F.col("entity_id").alias("id1"), "country"), "id1")
    hit = own.join(candidates.select("id1", "id2").distinct().withColumn("hit", F.lit(1)), ["id1", "id2"], "left")
    return hit.groupBy("country").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("true_pairs")).withColumn("recall", F.col("found") / F.col("true_pairs"))

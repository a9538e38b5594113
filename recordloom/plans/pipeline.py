"""The linkage pipeline from records to match lists, each stage a table that the next reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.config import Config
from recordloom.functions.text import enrich
from recordloom.functions.vectors import char_grams
from recordloom.operators import candidates, decide, features, metrics, model, rerank, sampling
from recordloom.sources import store, tsv


def hashed_vectors(entities: DataFrame, size: int = 256) -> DataFrame:
    """id, vec: unit vectors of the joint view's hashed n-grams, for the support features."""
    text = candidates.views()["both"]
    bucket = F.transform(char_grams(text, (3,)), lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int"))
    counts = entities.select(F.col("entity_id").alias("id"), F.explode(bucket).alias("b")).groupBy("id", "b").agg((1 + F.log(F.count(F.lit(1)))).alias("x"))
    row = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return row.select("id", vec.alias("vec"))


def stage(df: DataFrame, path: str | None) -> DataFrame:
    """Write and read back: in the given folder, or a table of its own in the shared folder."""
    if path is None:
        return store.keep(df, "stage")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare(records: DataFrame, cfg: Config, work: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, candidates, features) of records; an error if normalising lost or made rows."""
    at = lambda name: f"{work}/{name}" if work else None
    entities = stage(enrich(records), at("entities"))
    lost = store.conserved(records.select(F.substring("entity_id", 1, 2).alias("src")), entities).collect()  # a row for each source
    if lost:
        raise RuntimeError(f"rows lost or made while normalising: {lost}")
    cands = stage(candidates.block(entities, cfg), at("candidates"))
    return entities, cands, stage(features.pair_features(cands, entities), at("features"))


def with_texts(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """pairs with text1 and text2, what a re-ranker reads of the two entities."""
    texts = entities.select("entity_id", rerank.pair_text(F.col("name_full"), F.col("addr_full")).alias("t"))
    one, two = (texts.select(F.col("entity_id").alias(f"id{k}"), F.col("t").alias(f"text{k}")) for k in (1, 2))
    return pairs.join(one, "id1").join(two, "id2")


def link(train: DataFrame, truth: DataFrame, test: DataFrame, cfg: Config | None = None, work: str | None = None, **settings) -> dict:
    """Fit on train records and their true pairs, decide on validation entities, and match the test records.

    The re-ranker's scores are blended in, and its own rule used, where that beats the first decision on validation by
    more than rerank.GAIN. With work, stages are tables there and matches and candidates files beside them, one line
    for each source-1 entity in the order of entity ids, each with the fingerprint of the settings.
    Returns decision, rerank (its decision), chosen, matches (source1_entity_id, matched_entity_ids), candidates in the same form, fingerprint.
    """
    cfg = cfg or Config()
    sub = lambda s: f"{work}/{s}" if work else None
    train = sampling.hash_sample(train, "entity_id", cfg.train_frac) if cfg.train_frac < 1 else train
    entities, _, feats = prepare(train, cfg, sub("train"))
    stack = model.Stack(features.NAMES, cfg.max_train_pairs, **settings)
    scored = stage(stack.fit(stage(model.label_pairs(feats, truth), sub("labelled")), stage(hashed_vectors(entities), sub("vectors"))), sub("scored"))
    keys = model.folds(candidates.sides(entities)[0].select(F.col("entity_id").alias("id1")), "id1").where("val").select("id1")
    held = scored.where("val").select("id1", "id2", "p")
    decision = metrics.tune(held, truth, keys)
    second = rerank.tune_blend(stage(rerank.rescore(with_texts(held, entities)), sub("reranked")), truth, keys)
    chosen = rerank.pick(decision, second)

    e_test, c_test, f_test = prepare(test, cfg, sub("test"))
    pred = stage(stack.predict(f_test, stage(hashed_vectors(e_test), sub("test-vectors"))), sub("predicted")).select("id1", "id2", "p")
    rule = decision
    if chosen == "reranked":
        rule, pred = second, rerank.blend(rerank.rescore(with_texts(pred, e_test)), second["w"]).select("id1", "id2", "p")
    kept = decide.apply_rule(decide.exclusive(pred), rule["rule"], rule["threshold"])
    order = candidates.sides(e_test)[0].select(F.col("entity_id").alias("source1_entity_id"), "country")
    out = {
        "decision": decision, "rerank": second, "chosen": chosen, "matches": decide.match_lists(order, kept, by="p" if rule["rule"] == "expected_f" else "id2"),
        "candidates": decide.match_lists(order, c_test, "candidate_entity_ids"), "fingerprint": cfg.block_fingerprint(),
    }
    if work:
        for name in ("matches", "candidates"):
            tsv.write_tsv(out[name].orderBy("source1_entity_id"), f"{work}/{name}-{out['fingerprint'][:12]}.tsv")
    return out

"""The registered queries of the record-linkage operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import distance, text, vectors
from recordloom.operators import candidates, decide, features, graph, keys, knn, metrics, model, rerank, sampling
from recordloom.sources import proxy, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def entities(spark, sf_dir) -> DataFrame:
    """The test tables hold Western European letters only, so accents go without leaving the JVM."""
    return text.enrich(proxy.records(spark, sf_dir), text.strip_accents_latin)


def _r(c, places: int = 6):
    return F.round(c, places)


@query
def norm_strip_accents(spark, sf_dir):
    return proxy.table(spark, sf_dir, "documents").select("doc_id", text.strip_accents("text").alias("plain"))


@query
def norm_base_clean(spark, sf_dir):
    return proxy.table(spark, sf_dir, "documents").select("doc_id", text.base_clean(F.col("text")).alias("cleaned"))


@query
def norm_name_views(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", "name_full", "name_core", "name_sorted", "name_phon", "name_concat", "domain", "is_domain", "n_len")


@query
def norm_phonetic(spark, sf_dir):
    names = text.with_name(proxy.records(spark, sf_dir), "business_name", text.strip_accents_latin)
    return names.select(F.explode(text.words(F.col("name_full"))).alias("word")).distinct().select("word", text.phonetic(F.col("word")).alias("skeleton"))


@query
def norm_legal(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("legal").agg(F.count(F.lit(1)).alias("n"))


@query
def norm_address(spark, sf_dir):
    a = text.with_address(proxy.records(spark, sf_dir), "business_address", text.strip_accents_latin)
    return a.select(
        "entity_id", "addr_full", "addr_words", "addr_nums", "house_no", "postcode",
        F.regexp_replace("house_no", "[^0-9]", "").alias("house_dig"), F.coalesce(F.get(text.words(F.col("addr_nums")), F.lit(0)), F.lit("")).alias("num_tok"),
    )


@query
def street_locality(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", "street", "locality")


@query
def url_domain(spark, sf_dir):
    return proxy.table(spark, sf_dir, "pages").select("page_id", text.domain_of(F.lower("url")).alias("domain"))


@query
def customer_noise(spark, sf_dir):
    return proxy.table(spark, sf_dir, "customer").select("c_custkey", F.trim(text.without_noise(F.lower("c_name"))).alias("kept"))


@query
def entities_by_country(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("country", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("n_len").alias("core_words"))


@query
def transliterate_demo(spark, sf_dir):
    rows = [("ईस्टर्न कंस्ट्रक्शन",), ("গ্রেট অ্যাগ্রো লিমিটেড",), ("Maria’s Pizza",), ("റ്റാറ്റ എന്റർപ്രൈസ്",), ("plain",)]
    df = spark.createDataFrame(rows, "raw string")
    return df.select("raw", text.transliterate("raw").alias("latin"), text.has_indic(F.col("raw")).alias("native"))


# --- blocking -----------------------------------------------------------------------------------------------


@query
def block_keys(spark, sf_dir):
    return keys.key_rows(entities(spark, sf_dir)).select("id", "key")


@query
def key_frequency(spark, sf_dir):
    _, e2 = candidates.sides(entities(spark, sf_dir))
    n2 = e2.groupBy("country").agg(F.count(F.lit(1)).alias("n2"))
    return keys.key_frequency(keys.key_rows(e2), n2).select("country", "key", "df", _r("w").alias("w"))


def _key_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = store.keep(entities(spark, sf_dir), "entities")
    return e, keys.key_candidates(*candidates.sides(e))


@query
def key_candidates(spark, sf_dir):
    return _key_pairs(spark, sf_dir)[1].select("country", "id1", "id2", _r("sim").alias("sim"), "rank")


@query
def blocking_recall(spark, sf_dir):
    e, pairs = _key_pairs(spark, sf_dir)
    got = candidates.blocking_recall(pairs, proxy.truth(spark, sf_dir), candidates.sides(e)[0])
    return got.select("country", "found", "true_pairs", _r("recall").alias("recall"))


def _rows(e: DataFrame, column: str) -> DataFrame:
    return e.select("country", F.col("entity_id").alias("id"), F.col(column).alias("text"))


@query
def tfidf_char(spark, sf_dir):
    return vectors.tfidf(_rows(entities(spark, sf_dir), "name_core"), vectors.char_grams(F.col("text"))).select("id", "term", _r("w").alias("w"))


@query
def tfidf_word(spark, sf_dir):
    return vectors.tfidf(_rows(entities(spark, sf_dir), "addr_words"), vectors.word_grams(F.col("text"), 2)).select("id", "term", _r("w").alias("w"))


@query
def pair_cosine(spark, sf_dir):
    e, pairs = _key_pairs(spark, sf_dir)
    pairs = store.keep(pairs.select("country", "id1", "id2"), "key-pairs")
    vec = vectors.unit_vectors(_rows(e, "name_core"), vectors.char_grams(F.col("text")))
    return vectors.pair_cosine(pairs.select("country", "id1", "id2"), vec, "n_char").select("id1", "id2", _r("n_char").alias("n_char"))


@query
def text_topk(spark, sf_dir):
    e1, e2 = candidates.sides(entities(spark, sf_dir))
    return knn.topk_text(_rows(e1, "addr_full"), _rows(e2, "addr_full"), vectors.char_grams(F.col("text"), (3,)), 5).select("id1", "id2", _r("sim").alias("sim"), "rank")


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = proxy.vectors(spark, sf_dir)
    return v.where("id % 4 = 0"), v.where("id % 4 <> 0")


def _out(pairs: DataFrame) -> DataFrame:
    return pairs.select("id1", "id2", _r("sim").alias("sim"), "rank")


@query
def topk_dense(spark, sf_dir):
    return _out(knn.topk_dense(*_vectors(spark, sf_dir), 5))


@query
def topk_search(spark, sf_dir):
    return _out(knn.search(*_vectors(spark, sf_dir), 5))


@query
def reverse_topk(spark, sf_dir):
    a, b = _vectors(spark, sf_dir)
    return _out(knn.reverse(knn.topk_dense(b, a, 3)))


@query
def self_topk(spark, sf_dir):
    return _out(knn.self_neighbours(_vectors(spark, sf_dir)[1], 3))


@query
def two_hop(spark, sf_dir):
    a, b = _vectors(spark, sf_dir)
    hop = knn.two_hop(knn.topk_dense(a, b, 5), knn.self_neighbours(b, 3))
    return _out(hop.groupBy("id1", "id2").agg(F.max("sim").alias("sim"), F.min("rank").alias("rank")))


def _passes(spark, sf_dir) -> DataFrame:
    a, b = _vectors(spark, sf_dir)
    forward, back = knn.topk_dense(a, b, 5), knn.reverse(knn.topk_dense(b, a, 3))
    hop = knn.two_hop(forward, knn.self_neighbours(b, 3))
    return reduce(DataFrame.unionByName, [candidates.tagged(df, n) for df, n in ((forward, "name"), (back, "rev"), (hop, "hop"))])


@query
def union_candidates(spark, sf_dir):
    names = ["name", "rev", "hop"]
    got = candidates.union_candidates(_passes(spark, sf_dir), names)
    return got.select("id1", "id2", *[c for n in names for c in (_r(f"sim_{n}").alias(f"sim_{n}"), F.col(f"rank_{n}"))], "n_passes")


@query
def pivot_candidates(spark, sf_dir):
    got = candidates.pivot_candidates(_passes(spark, sf_dir), ["name", "rev", "hop"])
    return got.withColumns({f"sim_{n}": _r(f"sim_{n}") for n in ("name", "rev", "hop")})


@query
def topk_cells(spark, sf_dir):
    return _out(knn.topk_cells(*_vectors(spark, sf_dir), 5, cells=16, probes=6))


@query
def topk_lsh(spark, sf_dir):
    return _out(knn.topk_lsh(*_vectors(spark, sf_dir), 5))


# --- pair features --------------------------------------------------------------------------------------------


def _pairs_with(spark, sf_dir, made: dict, where=None) -> DataFrame:
    e, pairs = _key_pairs(spark, sf_dir)
    both = features.with_entities(pairs.select("country", "id1", "id2"), e)
    both = both.where(where) if where is not None else both
    return both.select("id1", "id2", *[_r(c).alias(n) for n, c in made.items()])


@query
def pair_overlap(spark, sf_dir):
    want = ["n_jac", "n_cont", "n_inter", "p_jac", "a_jac", "num_jac", "num_inter", "street_cont", "loc_jac", "lf_jac"]
    made = features.overlap_features()
    return _pairs_with(spark, sf_dir, {n: made[n] for n in want})


@query
def pair_house(spark, sf_dir):
    return _pairs_with(spark, sf_dir, features.house_features())


@query
def pair_flags(spark, sf_dir):
    made = features.flag_features() | features.legal_features()
    return _pairs_with(spark, sf_dir, {n: made[n] for n in ("dom_in_name", "n_first_eq", "is_s3", "n_len_diff", "lf_eq", "lf_empty1")})


@query
def pair_jaro(spark, sf_dir):
    named = "l.name_core <> '' and r.name_core <> ''"
    return _pairs_with(spark, sf_dir, {"rf_jaro": distance.jaro(F.col("l.name_core"), F.col("r.name_core"))}, named)


@query
def pair_fuzzy(spark, sf_dir):
    return _pairs_with(spark, sf_dir, features.fuzzy_features())


@query
def pair_features(spark, sf_dir):
    e, pairs = _key_pairs(spark, sf_dir)
    made = store.keep(candidates.union_candidates(candidates.tagged(pairs, "key")), "candidates")
    got = features.pair_features(made, e)
    return got.select("country", "id1", "id2", *[_r(n).alias(n) for n in features.NAMES])


# --- scores to decisions ----------------------------------------------------------------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    return knn.topk_dense(*_vectors(spark, sf_dir), 8).select("id1", "id2", _r((F.col("sim") + 1) / 2).alias("p"))


def _truth(spark, sf_dir) -> DataFrame:
    a, b = _vectors(spark, sf_dir)
    one = a.select(F.col("id").alias("id1"), "label", F.floor(F.col("id") / 4).alias("g")).withColumn("g", F.col("g") % 10)
    return one.join(b.select(F.col("id").alias("id2"), "label", (F.col("id") % 10).alias("g")), ["label", "g"]).select("id1", "id2")


def _keys(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir)[0].select(F.col("id").alias("id1"))


def _decided(spark, sf_dir) -> DataFrame:
    return decide.by_expected_f(decide.exclusive(_scored(spark, sf_dir)))


def _scores(spark, sf_dir) -> DataFrame:
    return metrics.entity_scores(_truth(spark, sf_dir), _decided(spark, sf_dir), _keys(spark, sf_dir))


@query
def competition_feats(spark, sf_dir):
    c = graph.competition(_scored(spark, sf_dir))
    return c.select("id1", "id2", "a_rank1", _r("a_gap1").alias("a_gap1"), "a_n_close1", _r("a_sum1").alias("a_sum1"), "a_rank2", _r("a_margin2").alias("a_margin2"), "a_n_owner2")


@query
def support_feats(spark, sf_dir):
    s = graph.support(_scored(spark, sf_dir), proxy.vectors(spark, sf_dir))
    return s.select("id1", "id2", _r("s_max").alias("s_max"), "s_cnt", _r("s_top").alias("s_top"))


@query
def exclusive_owner(spark, sf_dir):
    return decide.exclusive(_scored(spark, sf_dir))


@query
def threshold_matches(spark, sf_dir):
    return decide.by_threshold(decide.exclusive(_scored(spark, sf_dir)), 0.6503)


@query
def expected_f(spark, sf_dir):
    return _decided(spark, sf_dir).select("id1", "id2", "p")


@query
def entity_fbeta(spark, sf_dir):
    return _scores(spark, sf_dir).select("id1", "tp", "n_pred", "n_true", _r("f").alias("f"))


@query
def macro_f(spark, sf_dir):
    return metrics.macro_f(_scores(spark, sf_dir)).select(_r("macro_f").alias("macro_f"))


@query
def error_classes(spark, sf_dir):
    return metrics.points_lost(_scores(spark, sf_dir))


@query
def threshold_grid(spark, sf_dir):
    got = metrics.threshold_grid(decide.exclusive(_scored(spark, sf_dir)), _truth(spark, sf_dir), _keys(spark, sf_dir))
    return got.select("t", _r("macro_f").alias("macro_f"))


def _order(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir)[0].select(F.col("id").alias("source1_entity_id"), "country")


@query
def match_lists(spark, sf_dir):
    return decide.match_lists(_order(spark, sf_dir), _decided(spark, sf_dir))


@query
def match_coverage(spark, sf_dir):
    got = decide.coverage(_order(spark, sf_dir), _decided(spark, sf_dir))
    return got.select("country", "n_s1", "n_matches", _r("matches_per_s1").alias("matches_per_s1"), _r("empty_share").alias("empty_share"))


@query
def output_check(spark, sf_dir):
    return decide.check_lists(match_lists(spark, sf_dir), _order(spark, sf_dir))


@query
def rerank_jaccard(spark, sf_dir):
    side = lambda s: rerank.pair_text(F.col(f"{s}.name_full"), F.col(f"{s}.addr_full"))
    return _pairs_with(spark, sf_dir, {"p_ce": rerank.word_jaccard(side("l"), side("r"))})


@query
def rerank_blend(spark, sf_dir):
    pairs = _scored(spark, sf_dir).withColumn("p_ce", _r(F.col("p") * F.col("p")))
    return rerank.blend(pairs, 0.75).select("id1", "id2", _r("p", 9).alias("p"))


@query
def source_audit(spark, sf_dir):
    """Fixed numbers of rows (two tables), a number that follows from another table, a wrong number and a missing table: the last two are not ok."""
    tables = {n: proxy.table(spark, sf_dir, n) for n in ("region", "nation", "orders", "supplier")}
    orders = 10 * proxy.table(spark, sf_dir, "customer").count()
    return store.audit(spark, tables, {"region": 5, "nation": 25, "orders": orders, "supplier": 7, "missing": 1})


# --- sampling and models ------------------------------------------------------------------------------------------


@query
def fold_split(spark, sf_dir):
    e = entities(spark, sf_dir).select("entity_id")
    return sampling.folds(e, "entity_id")


@query
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(proxy.records(spark, sf_dir), "entity_id", 0.25).select("entity_id")


@query
def negative_sampling(spark, sf_dir):
    labelled = model.label_pairs(_scored(spark, sf_dir), _truth(spark, sf_dir))
    return sampling.subsample(labelled, 400).select("id1", "id2", "y", _r("weight", 9).alias("weight"))


@query
def gbt_stack(spark, sf_dir):
    """Two-stage model on embedding pairs; truth is the label."""
    a, b = _vectors(spark, sf_dir)
    pairs = knn.topk_dense(a, b, 8).withColumns({"rank": F.col("rank").cast("double"), "gap": F.abs(F.col("id1") - F.col("id2")).cast("double")})
    labels = a.select(F.col("id").alias("id1"), F.col("label").alias("l1")), b.select(F.col("id").alias("id2"), F.col("label").alias("l2"))
    rows = pairs.join(labels[0], "id1").join(labels[1], "id2").withColumn("y", (F.col("l1") == F.col("l2")).cast("int"))
    stack = model.Stack(["sim", "rank", "gap"], 100_000, rounds=5, depth=3)
    return stack.fit(rows.select("country", "id1", "id2", "sim", "rank", "gap", "y"), proxy.vectors(spark, sf_dir)).select("id1", "id2", "y", "pA", "p")


@query
def match_by_rare_keys(spark, sf_dir):
    """Records to match lists in one plan: normalise, rare keys, name and address overlap, one owner, threshold."""
    e, pairs = _key_pairs(spark, sf_dir)
    name, _, _ = features.overlap(F.col("l.name_core"), F.col("r.name_core"))
    place, _, _ = features.overlap(F.col("l.addr_words"), F.col("r.addr_words"))
    scored = features.with_entities(pairs.select("country", "id1", "id2"), e).select("id1", "id2", _r((name + place) / 2).alias("p"))
    chosen = decide.by_threshold(decide.exclusive(scored), 0.4)
    return decide.match_lists(candidates.sides(e)[0].select(F.col("entity_id").alias("source1_entity_id")), chosen)

"""Rare-key blocking: an inverted index of typed keys, cut by document frequency before the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import words
from recordloom.sources.store import keep


def _tag(prefix: str, arr: Column) -> Column:
    return F.transform(arr, lambda x: F.concat(F.lit(prefix), x))


def _pairs(arr: Column, between: str) -> Column:
    n = F.size(arr)
    made = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(arr, i), F.lit(between), F.get(arr, i + 1)))
    return F.when(n > 1, made).otherwise(F.array().cast("array<string>"))


def _scoped(arr: Column, places: Column, apart: bool = False) -> Column:
    """Each element of arr at each of places (not at itself if apart)."""
    at = lambda x: F.transform(F.filter(places, lambda p: p != x) if apart else places, lambda p: F.concat(x, F.lit("@"), p))
    return F.flatten(F.transform(arr, at))


def record_keys(e: DataFrame, with_locality: bool = True) -> Column:
    """The distinct blocking keys of an entity record, as an array.

    A: numbers of the address; H: number and the next street word; N, B, P: name words, neighbours, skeletons;
    D: domain; L, Q: name word or skeleton in one of the first two locality words; G: neighbouring digit
    groups; g, W: digit group or street word in one of the last six distinct locality words.
    """
    at, core, phon, nums = words(F.col("addr_full")), words(F.col("name_core")), words(F.col("name_phon")), words(F.col("addr_nums"))
    long3 = lambda arr: F.filter(arr, lambda t: F.length(t) >= 3)
    numbered = lambda t: t.rlike("[0-9]")
    follower = lambda i: F.get(F.filter(F.slice(at, i + 2, 2), lambda w: w.rlike("^[a-z]+$") & (F.length(w) > 2)), F.lit(0))
    house = F.filter(
        F.transform(at, lambda t, i: F.when(numbered(t), F.concat(t, F.lit("_"), F.substring(follower(i), 1, 5)))), lambda k: k.isNotNull()
    )
    parts = [
        _tag("A:", F.filter(at, lambda t: numbered(t) & (F.length(t) >= 4))),
        _tag("H:", house),
        _tag("A:", F.transform(F.filter(nums, lambda n: n.contains("/") | (F.length(n) >= 4)), lambda n: F.replace(n, F.lit("/"), F.lit("")))),
        _tag("N:", long3(core)),
        _tag("B:", _pairs(core, "_")),
        _tag("P:", long3(phon)),
        F.when(F.col("domain") != "", F.array(F.concat(F.lit("D:"), "domain"))).otherwise(F.array().cast("array<string>")),
    ]
    if with_locality:
        loc = words(F.col("locality"))
        first = F.slice(loc, 1, 2)
        distinct = F.array_distinct(loc)
        last = F.slice(distinct, F.greatest(F.size(distinct) - 5, F.lit(1)), 6)
        groups = F.transform(F.regexp_extract_all("addr_full", F.lit(r"\d+"), F.lit(0)), lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0")))
        streets = F.filter(words(F.col("street")), lambda w: F.length(w) >= 4)
        parts += [
            _tag("L:", _scoped(long3(core), first)),
            _tag("Q:", _scoped(long3(phon), first)),
            _tag("G:", _pairs(groups, "_")),
            _tag("g:", _scoped(F.filter(groups, lambda g: F.length(g) >= 2), last)),
            _tag("W:", _scoped(streets, last, apart=True)),
        ]
    keys = F.array_distinct(F.concat(*parts))
    return _tag("|", keys) if e is None else F.transform(keys, lambda k: F.concat(F.col("country"), F.lit("|"), k))


def key_rows(e: DataFrame, with_locality: bool = True) -> DataFrame:
    """country, id, key: one row for each distinct key of a record (entity columns with id as entity_id)."""
    return e.select("country", F.col("entity_id").alias("id"), F.explode(record_keys(e, with_locality)).alias("key"))


def key_frequency(keys2: DataFrame, n2: DataFrame, max_df: int | None = 40) -> DataFrame:
    """country, key, df, w of the keys of the candidate side with df <= max_df; w = ln(1 + N2 / df)."""
    df = keys2.groupBy("country", "key").agg(F.count(F.lit(1)).alias("df"))
    if max_df is not None:
        df = df.where(F.col("df") <= max_df)
    return df.join(n2, "country").withColumn("w", F.log1p(F.col("n2") / F.col("df")))


def key_candidates(e1: DataFrame, e2: DataFrame, k: int = 30, max_df: int = 40, with_locality: bool = True) -> DataFrame:
    """country, id1, id2, sim (sum of weights of shared rare keys), rank (from 0, < k).

    Stop keys go before the join, so its fan-out is at most max_df for each key of the first side. Ties by
    id2. Without shared keys the result is empty.
    """
    n2 = e2.groupBy("country").agg(F.count(F.lit(1)).alias("n2"))
    # keys are made once for both sides; their expressions are long, and three copies of them weigh on the driver
    made = lambda e, side: e.select("country", F.col("entity_id").alias("id"), record_keys(e, with_locality).alias("ks"), F.lit(side).alias("side"))
    kept = keep(made(e1, 1).unionByName(made(e2, 2)), "keys")
    rows = lambda side: kept.where(F.col("side") == side).select("country", "id", F.explode("ks").alias("key"))
    keys2 = rows(2)
    rare = key_frequency(keys2, n2, max_df).select("country", "key", "w")
    index = keys2.join(rare, ["country", "key"]).select("country", "key", F.col("id").alias("id2"), "w")
    met = rows(1).select("country", "key", F.col("id").alias("id1")).join(index, ["country", "key"])
    score = met.groupBy("country", "id1", "id2").agg(F.round(F.sum("w"), 9).alias("sim"))
    return top_ranked(score, "id1", "id2", k)


def top_ranked(pairs: DataFrame, left: str, right: str, k: int, places: int | None = None) -> DataFrame:
    """The k rows of largest sim for each left id, rank from 0; ties by right id.

    With places, sims that are equal when so rounded are ties: sums of the same weights in another order differ in their last bits.
    """
    sim = F.col("sim") if places is None else F.round("sim", places)
    best = Window.partitionBy("country", left).orderBy(sim.desc(), right)
    return pairs.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)

"""k-nearest-neighbour joins: dense vectors (exact, cells), sparse text vectors, reverse, self and two-hop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.vectors import inner_product, sparse_vectors
from recordloom.sources.store import keep

from .keys import top_ranked

BLOCK = 4096
GROUP_BLOCK = 32768
"""Rows of a block of a cell or bucket: larger ones are copied less often."""
QUERY_BLOCK = 8192
"""Rows of a block of texts to search for; those searched in come in blocks of GROUP_BLOCK."""
CELLS_AT_ONCE = 2_000_000


def _met(left: DataFrame, right: DataFrame, groups: list[str], k: int, block: int, radius: float | None = None) -> DataFrame:
    """country, id1, id2, sim: the k best of each left row in each of its groups; left, right: country, *groups, id, vec.

    Both sides of a group are cut into blocks of about `block` rows by a hash of id; a task multiplies one block by
    one block, some rows at a time, and keeps its k best. A task holds two blocks, however large the groups are; of
    equal rows no more than k leave it. With radius, only pairs at a smaller distance count, sim is 1 - distance**2 / 2.
    """
    on = ["country", *groups]

    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))

    sizes = sized(left, "na").join(sized(right, "nb"), on)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = left.join(sizes, on).select(*on, place("na").alias("i"), copies("nb").alias("j"), "id", "vec", F.lit(True).alias("query"))
    index = right.join(sizes, on).select(*on, copies("na").alias("i"), place("nb").alias("j"), "id", "vec", F.lit(False).alias("query"))

    def candidates(score: np.ndarray, near: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places (row, column) that are near and may be among the k largest of their row, however a product is summed."""
        if near is None or near.sum() > near.size // 20:
            score = score if near is None else np.where(near, score, -np.inf)
            last = score.shape[1] - min(k, score.shape[1])
            near = (score >= np.partition(score, last, axis=1)[:, last, None] - 1e-9) & (score > -np.inf)
        return np.nonzero(near)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id")
        if q.empty or c.empty:
            return pd.DataFrame({"country": [], "id1": [], "id2": [], "sim": []})
        x, y = (np.stack(side["vec"].to_numpy()).astype(np.float64) for side in (q, c))
        # of equal vectors no more than the k of smallest ids can be among the best
        same = np.unique(y, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")
        place = np.empty(len(y), np.int64)
        place[order] = np.arange(len(y)) - np.searchsorted(same[order], same[order])
        c, y = c[place < k], y[place < k]
        found, rows, yy = [], max(1, CELLS_AT_ONCE // len(y)), (y**2).sum(axis=1)
        for lo in range(0, len(x), rows):
            some = x[lo : lo + rows]
            if radius is None:
                at, to = candidates(some @ y.T, None)
            else:
                score = 2 * some @ y.T - yy  # what the squared distance is short of that of the row to 0
                at, to = candidates(score, score > ((some**2).sum(axis=1) - radius**2 - 1e-9)[:, None])
            # summed in the order of the places, so that equal vectors have equal values in all tasks
            value = np.zeros(len(at))
            for d in range(y.shape[1]):
                value += some[at, d] * y[to, d] if radius is None else (some[at, d] - y[to, d]) ** 2
            if radius is not None:
                inside = value < radius**2
                at, to, value = at[inside], to[inside], 1 - value[inside] / 2
            order = np.lexsort((to, -value, at))
            at, to, value = at[order], to[order], value[order]
            few = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append((at[few] + lo, to[few], value[few]))
        at, to, sim = (np.concatenate(z) for z in zip(*found, strict=True))
        return pd.DataFrame({"country": pdf["country"].iloc[0], "id1": q["id"].to_numpy()[at], "id2": c["id"].to_numpy()[to], "sim": sim})

    kind = dict(left.dtypes)["id"]
    return queries.unionByName(index).groupBy(*on, "i", "j").applyInPandas(best, f"country string, id1 {kind}, id2 {kind}, sim double")


def topk_dense(a: DataFrame, b: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact inner-product top k of each row of a among rows of b of the same country.

    a, b: country, id, vec (array of float). Both sides are multiplied in blocks, see _met(), and a window merges
    the blocks; blocks of different countries never meet.
    Returns country, id1, id2, sim, rank (from 0); ties by id2. Null vectors match nothing.
    """
    side = lambda df: df.where("vec is not null").select("country", "id", "vec")
    return top_ranked(_met(side(a), side(b), [], k, block), "id1", "id2", k)


def topk_sql(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """As topk_dense(), by an equi-join on country and built-in functions: for small tables only."""
    pairs = a.select("country", F.col("id").alias("id1"), F.col("vec").alias("v1")).join(b.select("country", F.col("id").alias("id2"), F.col("vec").alias("v2")), "country")
    return top_ranked(pairs.select("country", "id1", "id2", inner_product(F.col("v1"), F.col("v2")).alias("sim")), "id1", "id2", k)


def topk_cells(a: DataFrame, b: DataFrame, k: int, cells: int = 64, probes: int = 8, sample: int = 100_000, seed: int = 0) -> DataFrame:
    """Approximate top k through an inverted file: k-means cells of b, each row of a probes its nearest.

    Centres are fitted on a bounded sample; every row of b is indexed. With probes = cells it is exact.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fit = b.where("vec is not null").orderBy(F.xxhash64("id")).limit(sample).select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    if fit.isEmpty():
        return topk_sql(a, b, k)
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(fit).clusterCenters())

    def nearest(most: int):
        @F.pandas_udf("array<int>")
        def run(vec: pd.Series) -> pd.Series:
            x = np.stack(vec.to_numpy()).astype(np.float64)
            d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2) if len(x) * len(centres) < 2_000_000 else (centres**2).sum(axis=1) - 2 * x @ centres.T
            return pd.Series(list(np.argsort(d, axis=1)[:, :most].astype(np.int32)))

        return run

    # cells are found once; counts and blocks of them are taken from the tables
    left = keep(a.where("vec is not null").select("country", "id", "vec", nearest(min(probes, len(centres)))("vec").alias("cells")), "probes")
    right = keep(b.where("vec is not null").select("country", "id", "vec", F.get(nearest(1)("vec"), F.lit(0)).alias("cell")), "cells")
    return top_ranked(_met(left.select("country", F.explode("cells").alias("cell"), "id", "vec"), right, ["cell"], k, GROUP_BLOCK), "id1", "id2", k)


def search(a: DataFrame, b: DataFrame, k: int, mode: str = "auto", exact_up_to: int = 50_000, probes: int = 96) -> DataFrame:
    """Top k by the size of b: topk_dense() while no country has more than exact_up_to rows, else topk_cells().

    mode: "exact" or "ivf" choose one of them, "auto" goes by size. Cells number 4 * sqrt(rows of the largest country),
    256 at least and 16384 at most; `probes` of them are read for each query row (96 of 256 find over 0.9 of the exact neighbours among spread-out vectors).
    """
    if mode not in ("auto", "exact", "ivf"):
        raise ValueError(f"mode {mode!r}")
    sizes = b.groupBy("country").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    n = sizes.first()["n"] if mode != "exact" else 0
    if mode == "exact" or (mode == "auto" and n <= exact_up_to):
        return topk_dense(a, b, k)
    cells = min(16384, max(256, int(4 * n**0.5)))
    return topk_cells(a, b, k, cells=cells, probes=min(probes, cells))


def topk_lsh(a: DataFrame, b: DataFrame, k: int, radius: float = 1.2, bucket: float = 0.8, tables: int = 8, seed: int = 0) -> DataFrame:
    """Approximate top k of unit vectors by random-projection LSH; sim = 1 - distance**2 / 2.

    The rows of a bucket are multiplied in blocks and leave with their k best, so vectors are copied for each table and
    block, not for each pair.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda df: df.where("vec is not null").select("country", "id", "vec", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    if b.where("vec is not null").isEmpty():
        return topk_sql(a, b, k)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(vec(b))

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        buckets = F.array(*[F.get(vector_to_array(F.get("hashes", F.lit(t))), F.lit(0)).cast("bigint") for t in range(tables)])
        kept = keep(model.transform(vec(df)).select("country", "id", "vec", buckets.alias("buckets")), name)
        return kept.select("country", F.posexplode("buckets").alias("t", "bucket"), "id", "vec")

    # the best of all tables are among the best of each; a pair may meet in several
    met = _met(bucketed(a, "lsh-queries"), bucketed(b, "lsh-index"), ["t", "bucket"], k, GROUP_BLOCK, radius)
    return top_ranked(met.groupBy("country", "id1", "id2").agg(F.max("sim").alias("sim")), "id1", "id2", k)


def _met_sparse(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """country, id1, id2, sim: of each left row, the k best right rows of its country that share a term with it.

    left, right: country, id, ts (term numbers, ascending), ws (weights over 0 of a vector of length 1). Blocks meet as in
    _met(). A task indexes the rows of its right block by term and adds up the products of one left row at a time, rare
    terms first. Once the terms that are left cannot lift a row without products among the k best (by their length, as
    the other vector's is 1 at most), only rows near enough are added up to the end; no row is left out otherwise.
    Equal vectors are added up once; of them no more than the k of smallest ids can be among the best.
    """

    def sized(df: DataFrame, name: str, n) -> DataFrame:
        return df.groupBy("country").agg(F.count(F.lit(1)).alias("n")).select("country", n(F.col("n")).cast("int").alias(name))

    blocks = lambda size: lambda n: F.ceil(n / F.lit(size))
    # small tables are cut as well, so that more than one task has work
    few = lambda n: F.greatest(blocks(QUERY_BLOCK)(n), F.least(F.lit(8), blocks(QUERY_BLOCK // 16)(n)))
    sizes = F.broadcast(sized(left, "na", few).join(sized(right, "nb", blocks(GROUP_BLOCK)), "country"))  # a row for each country
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = left.join(sizes, "country").select("country", place("na").alias("i"), copies("nb").alias("j"), "id", "ts", "ws", F.lit(True).alias("query"))
    index = right.join(sizes, "country").select("country", copies("na").alias("i"), place("nb").alias("j"), "id", "ts", "ws", F.lit(False).alias("query"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"country": [], "id1": [], "id2": [], "sim": []}).astype({"country": object, "id1": pdf["id"].dtype, "id2": pdf["id"].dtype})
        q, c = pdf[pdf["query"]].reset_index(drop=True), pdf[~pdf["query"]].sort_values("id").reset_index(drop=True)
        if q.empty or c.empty:
            return none
        same = lambda side: pd.factorize(np.array([t.tobytes() + w.tobytes() for t, w in zip(side["ts"], side["ws"])], dtype=object))[0]
        of_q, of_c = same(q), same(c)
        order = np.argsort(of_c, kind="stable")  # the places in c of each different vector, by id
        first = np.searchsorted(of_c[order], np.arange(of_c.max() + 2))
        own = [order[x : min(y, x + k)] for x, y in zip(first, first[1:])]
        rows = c.iloc[order[first[:-1]]]
        n, lens = len(rows), np.array([len(t) for t in rows["ts"]])
        start = np.concatenate([[0], np.cumsum(lens)])
        terms, code = np.unique(np.concatenate(rows["ts"].to_numpy()), return_inverse=True)
        weight, row = np.concatenate(rows["ws"].to_numpy()), np.repeat(np.arange(n), lens)
        by_term = np.argsort(code, kind="stable")
        posted, posted_w, ends = row[by_term], weight[by_term], np.searchsorted(code[by_term], np.arange(len(terms) + 1))
        mine, total = np.zeros(len(terms)), np.zeros(n)
        at, to, sims = [], [], []
        copies_of = pd.Series(np.arange(len(q))).groupby(of_q).indices
        for same_q in copies_of.values():
            ts, ws = q["ts"].iat[same_q[0]], q["ws"].iat[same_q[0]]
            x = np.searchsorted(terms, ts).clip(max=len(terms) - 1)
            x, w = x[terms[x] == ts], ws[terms[x] == ts]
            if not len(x):
                continue
            df = ends[x + 1] - ends[x]
            o = np.argsort(df, kind="stable")
            x, w, df = x[o], w[o], df[o]
            rest = np.sqrt(np.append(np.cumsum((w**2)[::-1])[::-1], 0.0))  # length of the terms from each on
            total[:] = 0
            near = None
            for i in range(len(x)):
                if k < n and df[i] > n // 16 and df[i:].sum() > 2 * n and rest[i] < 0.75:
                    least = np.partition(total, n - k)[n - k]
                    if least > rest[i] + 1e-8:
                        found = np.nonzero(total >= least - rest[i] - 1e-8)[0]
                        if lens[found].sum() < df[i:].sum():
                            near = found
                            break
                lo, hi = ends[x[i]], ends[x[i] + 1]
                total[posted[lo:hi]] += w[i] * posted_w[lo:hi]
            if near is None:
                near = np.nonzero(total)[0]
                value = total[near]
            else:
                mine[x[i:]] = w[i:]
                size = lens[near]
                places = np.repeat(start[near] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                value = total[near] + np.bincount(np.repeat(np.arange(len(near)), size), mine[code[places]] * weight[places], len(near))
                mine[x[i:]] = 0
            if len(value) > k:
                high = value >= np.partition(value, len(value) - k)[len(value) - k] - 2e-9
                near, value = near[high], value[high]
            ids = np.concatenate([own[d] for d in near])
            value = np.repeat(value, [len(own[d]) for d in near])
            few = np.lexsort((ids, -np.round(value, 9)))[:k]
            at.append(np.repeat(same_q, len(few)))
            to.append(np.tile(ids[few], len(same_q)))
            sims.append(np.tile(value[few], len(same_q)))
        if not at:
            return none
        at, to, sims = (np.concatenate(z) for z in (at, to, sims))
        return pd.DataFrame({"country": pdf["country"].iloc[0], "id1": q["id"].to_numpy()[at], "id2": c["id"].to_numpy()[to], "sim": sims})

    kind = dict(left.dtypes)["id"]
    return queries.unionByName(index).groupBy("country", "i", "j").applyInPandas(best, f"country string, id1 {kind}, id2 {kind}, sim double")


def topk_text(a: DataFrame, b: DataFrame, grams, k: int) -> DataFrame:
    """Exact TF-IDF cosine top k between texts of a and b (country, id, text): of all rows that share a term, see _met_sparse().

    Document frequencies come from both sides. Similarities equal to nine places are ties.
    """
    given = lambda df, query: df.select("country", "id", "text", F.lit(query).alias("query"))
    rows = keep(given(a, True).unionByName(given(b, False)), "texts")
    vectors = sparse_vectors(rows, grams)
    side = lambda query: vectors.join(rows.where(F.col("query") == query), ["country", "id"], "left_semi")
    return top_ranked(_met_sparse(side(True), side(False), k), "id1", "id2", k, places=9)


def reverse(pairs: DataFrame) -> DataFrame:
    """Results of a search from side 2 to side 1, as (id1, id2) rows; rank stays that of the search."""
    return pairs.withColumnsRenamed({"id1": "id2_", "id2": "id1_"}).withColumnsRenamed({"id1_": "id1", "id2_": "id2"})


def self_neighbours(b: DataFrame, k: int, search=topk_dense) -> DataFrame:
    """Each row's neighbours among the others of its table: a search for k + 1 whose self-hit goes.

    rank keeps the place in the search, so the self-hit leaves a gap, mostly at 0.
    """
    return search(b, b, k + 1).where("id1 <> id2")


def two_hop(forward: DataFrame, hops: DataFrame, seeds: int = 3) -> DataFrame:
    """id1's first `seeds` candidates of each given search, joined with their own neighbours.

    sim and rank are those of the second step; a pair reached in several ways stands several times.
    """
    near = forward.where(F.col("rank") < seeds).select("country", "id1", F.col("id2").alias("via"))
    return near.join(hops.select("country", F.col("id1").alias("via"), "id2", "sim", "rank"), ["country", "via"]).select("country", "id1", "id2", "sim", "rank")

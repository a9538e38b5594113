"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b bigint) -> (id, comp): each id on an edge and the smallest id it can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014); each step is a min aggregation
    and an equi-join on ids, and each round is written to the shared folder. A hub with very many
    neighbours is aggregated on the map side. Nothing is gathered on the driver but a count.
    Nulls and loops (a = b) are ignored; an empty table gives an empty table.
    """
    cur = keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # large star: each larger neighbour of v points to the smallest of v and its neighbours
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.where("m <> a").select("a", F.col("m").alias("b"))
        ).distinct()
        # small star: the smaller neighbours of v and v itself point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = keep(
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        # done when every node points to one node that itself points nowhere
        bad = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = bad or small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        forget(cur)
        cur = small
        if not chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return cur.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots)

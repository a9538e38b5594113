"""Re-scoring of ambiguous pairs and blending with the first score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import words

from .decide import by_expected_f, exclusive
from .metrics import BLENDS, COARSE, entity_scores, macro_f, threshold_grid

LOW, HIGH = 0.02, 0.995
GAIN = 0.0005

Scorer = Callable[[Column, Column], Column]
"""Two texts of a pair -> a score between 0 and 1."""


def pair_text(name: Column, address: Column) -> Column:
    return F.substring(F.concat(name, F.lit(" | "), address), 1, 160)


def word_jaccard(a: Column, b: Column) -> Column:
    """The default scorer: shared words over all words of the two texts."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def ambiguous(pairs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    return pairs.where(F.col("p").between(low, high))


def training_rows(pairs: DataFrame, low: float = LOW) -> DataFrame:
    """Rows a re-ranker is fitted on: p > low / 2 and not for validation."""
    return pairs.where((F.col("p") > low / 2) & ~F.col("val"))


def rescore(pairs: DataFrame, scorer: Scorer = word_jaccard) -> DataFrame:
    """pairs with text1, text2 -> p_ce: the scorer's value where p is ambiguous, else p."""
    return pairs.withColumn("p_ce", F.when(F.col("p").between(LOW, HIGH), scorer(F.col("text1"), F.col("text2"))).otherwise(F.col("p")))


def blend(pairs: DataFrame, w: float) -> DataFrame:
    """p = w * p + (1 - w) * p_ce within [LOW, HIGH]; other rows keep p."""
    mixed = w * F.col("p") + (1 - w) * F.col("p_ce")
    return pairs.withColumn("p", F.when(F.col("p").between(LOW, HIGH), mixed).otherwise(F.col("p")))


def tune_blend(pairs: DataFrame, truth: DataFrame, keys: DataFrame) -> dict:
    """Best (rule, w, threshold) over the blends; an equal score never replaces an earlier one."""
    best: dict = {"f_val": -1.0}
    for w in BLENDS:
        owned = exclusive(blend(pairs, w)).select("id1", "id2", "p")
        for r in sorted(threshold_grid(owned, truth, keys, tuple(COARSE)).collect(), key=lambda r: r["t"]):
            if r["macro_f"] > best["f_val"]:
                best = {"f_val": r["macro_f"], "rule": "threshold", "w": w, "threshold": r["t"]}
        f = macro_f(entity_scores(truth, by_expected_f(owned), keys)).first()["macro_f"]
        if f > best["f_val"]:
            best = {"f_val": f, "rule": "expected_f", "w": w, "threshold": None}
    return best


def pick(first: dict, second: dict | None) -> str:
    """'reranked' when its score beats the first's better rule by more than GAIN, else 'first'."""
    base = max(first.get("f_expected", 0.0), first.get("f_threshold", 0.0))
    return "reranked" if second and second.get("f_val", 0.0) > base + GAIN else "first"

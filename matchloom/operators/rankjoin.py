"""The best pairs by a weighted sum of scores, from each score's own best lists: a threshold join.

Each score gives a list of every lost item's best partners, falling. A pair in none of the lists can't exceed the weighted sum of
the lists' last scores. Where the k-th best pair of the lists is above that, or that is under the minimum, the item is
done; for the others the lists are made longer. Only pairs of the lists get all their scores.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize
from ..functions import vectors as V
from .blocks import BLOCK, best_k, similarities

#: Entries of lists that a block puts out at most, if one row's don't take more.
ENTRIES = 1 << 18


class RankJoin:
    """``weights`` by vector column, cosine similarities. After :meth:`run`, ``rounds`` has (items, pairs scored) of each round."""

    def __init__(self, weights: dict[str, float], k: int = 5, minimum: float = 0.0, by: str | None = "category", first: int | None = None):
        if min(weights.values()) < 0:
            raise ValueError("the bound needs weights that aren't negative")
        self.weights, self.k, self.minimum, self.by, self.first, self.rounds = weights, k, minimum, by, first or 4 * k, []

    def _list(self, lost: DataFrame, found: DataFrame, column: str, m: int) -> DataFrame:
        def score(a: pd.DataFrame, b: pd.DataFrame) -> dict:
            return {column: similarities(a[column], b[column])}

        use = ["id", *([self.by] if self.by else []), column]
        return best_k(lost.select(*use), found.select(*use), score, m, self.by, block=max(64, min(BLOCK, ENTRIES // m))).select("lost_id", "found_id", column, F.lit(column).alias("of"), "rank")

    def run(self, lost: DataFrame, found: DataFrame) -> DataFrame:
        """(lost_id, found_id, similarity, a similarity per column, rank); ties go to the smaller found id."""
        columns, m, done, self.rounds = list(self.weights), self.first, None, []
        side = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        lefts, rights, pending = side(lost, "lost"), side(found, "found"), lost
        while True:
            lists = [materialize(self._list(pending, found, c, m), "list") for c in columns]
            pairs = lists[0].select("lost_id", "found_id")
            for other in lists[1:]:
                pairs = pairs.unionByName(other.select("lost_id", "found_id"))
            scored = pairs.distinct().join(lefts, "lost_id").join(rights, "found_id")
            for c in columns:
                scored = scored.withColumn(f"{c}_similarity", V.cosine(F.col(f"lost_{c}"), F.col(f"found_{c}")))
            total = sum((w * F.col(f"{c}_similarity") for c, w in self.weights.items()), F.lit(0.0))
            scored = materialize(scored.select("lost_id", "found_id", total.alias("similarity"), *(f"{c}_similarity" for c in columns)), "scored")
            ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lost_id").orderBy(F.desc("similarity"), "found_id"))).where(F.col("rank") <= self.k)
            # What a pair outside the lists can have at most; nothing is outside of a list that isn't full.
            ends = None
            for c, rows in zip(columns, lists):
                end = rows.groupBy("lost_id").agg(F.count("*").alias(f"{c}_n"), F.min(c).alias(f"{c}_end"))
                ends = end if ends is None else ends.join(end, "lost_id")
            full = F.lit(True)
            for c in columns:
                full = full & (F.col(f"{c}_n") == m)
            bound = F.when(full, sum((w * F.col(f"{c}_end") for c, w in self.weights.items()), F.lit(0.0)))
            kth = ranked.where(F.col("rank") == self.k).select("lost_id", F.col("similarity").alias("kth"))
            open_ = ends.withColumn("bound", bound).join(kth, "lost_id", "left").where(F.col("bound").isNotNull() & (F.col("bound") >= self.minimum - 1e-9) & (F.col("kth").isNull() | (F.col("kth") <= F.col("bound") + 1e-9)))
            still = materialize(open_.select("lost_id"), "open")
            out = ranked.join(still, "lost_id", "left_anti")
            done = out if done is None else done.unionByName(out)
            left = still.count()
            self.rounds.append((ends.count(), scored.count()))
            if not left:
                return done.where(F.col("similarity") >= self.minimum)
            pending, m = lost.join(still.withColumnRenamed("lost_id", "id"), "id", "left_semi"), 4 * m

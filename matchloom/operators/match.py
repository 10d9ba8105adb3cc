"""Pairs of lost and found items, their scores and their ranking.

Blocking by category is an equi-join; time validity is its residual. Scores are computed once per pair: ranking comes
first and thresholds after it, which gives the same rows as filtering first but keeps the score out of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .allpairs import ranked
from .blocks import best_k, similarities


def side(items: DataFrame, status: str, prefix: str) -> DataFrame:
    rows = items.where(F.col("status") == status)
    return rows.select(*(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns))


def candidates(items: DataFrame, category: bool = True, temporal: bool = False) -> DataFrame:
    """Pairs with columns lost_* and found_*. Without ``category`` every pair meets every other, in a nested loop."""
    lost, found = side(items, "lost", "lost"), side(items, "found", "found")
    on = []
    if category:
        on.append(lost.lost_category.eqNullSafe(found.found_category))
    if temporal:
        later = F.coalesce(found.found_ts >= lost.lost_ts, F.lit(True))
        # Times with and without an offset can't be compared, so such a pair is valid.
        on.append(~lost.lost_zoned.eqNullSafe(found.found_zoned) | later if "zoned" in items.columns else later)
    if not on:
        return lost.crossJoin(found)
    cond = on[0] if len(on) == 1 else on[0] & on[1]
    return lost.join(found, cond)


def validity(category: bool = True, temporal: bool = True) -> Column:
    """Why a pair is rejected: category before time; null if it is valid."""
    bad_category = ~F.col("lost_category").eqNullSafe(F.col("found_category")) & F.lit(category)
    bad_time = ~F.coalesce(F.col("found_ts") >= F.col("lost_ts"), F.lit(True)) & F.lit(temporal)
    return F.when(bad_category, "category_mismatch").when(bad_time, "temporal_invalid")


def with_units(items: DataFrame, col: str = "image") -> DataFrame:
    """Unit vectors once per item, so that a pair's cosine is one dot product."""
    return items.withColumn(col, V.unit(F.col(col)))


def rank(scored: DataFrame, k: int | None = 5, by: str = "similarity", group: str = "lost_id", tie: Column | None = None) -> DataFrame:
    """``rank`` from 1 within ``group`` by falling score; ties by found_id, or ``tie``. All rows if ``k`` is None."""
    w = Window.partitionBy(group).orderBy(F.desc(by), F.asc("found_id") if tie is None else tie)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int | None = None, default: int = 5, minimum: float | None = None, by: str = "similarity") -> DataFrame:
    """The best ``k`` per lost item at or above ``minimum``; a k of 0 or None stands for the default."""
    out = rank(scored, k or default, by)
    return out if minimum is None else out.where(F.coalesce(F.col(by), F.lit(0.0)) >= minimum)


def image_matches(items: DataFrame, k: int | None = 5, minimum: float | None = None, temporal: bool = False, category: bool = True, last_first: bool = False) -> DataFrame:
    """(lost_id, found_id, similarity, rank) by cosine of the image vectors; every rank if ``k`` is None. Ties as in :func:`.blocks.best_k`."""
    if k is None and not temporal and not last_first:
        return ranked(items, minimum, "category" if category else None)
    if k is None:
        pairs = candidates(with_units(items.select("id", "category", "status", "ts", "image")), category, temporal)
        scored = pairs.select("lost_id", "found_id", F.coalesce(V.dot(F.col("lost_image"), F.col("found_image")), F.lit(0.0)).alias("similarity"))
        out = rank(scored, None)
    else:
        use = ["id", "category", "ts", "image"] if temporal else ["id", "category", "image"]
        of = lambda status: items.where(F.col("status") == status).select(*use)
        cosine = lambda a, b: {"similarity": similarities(a["image"], b["image"])}
        out = best_k(of("lost"), of("found"), cosine, k or 5, "category" if category else None, temporal, last_first)
    return out if minimum is None else out.where(F.col("similarity") >= minimum)


def lookup_metadata(matches: DataFrame, items: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Matches with the found item's category ("unknown" without metadata) and description."""
    meta = items.select(F.col("id").alias("found_id"), F.col("category").alias("found_category"), F.col("description").alias("found_description"))
    out = matches.join(meta, "found_id", "left" if keep_unknown else "inner")
    return out.withColumn("found_category", F.coalesce(F.col("found_category").cast("string"), F.lit("unknown")))


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    return df.orderBy(order).offset((number - 1) * size).limit(size)


def summary(lost: DataFrame, matches: DataFrame) -> DataFrame:
    """Per lost item: number of matches, best match and its score; null and 0 without any."""
    per = matches.groupBy("lost_id").agg(F.count("*").alias("num_matches"), F.min_by("found_id", "rank").alias("best_match"), F.max("similarity").alias("best_similarity"))
    return lost.join(per, "lost_id", "left").na.fill(0, ["num_matches", "best_similarity"])

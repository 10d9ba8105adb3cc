"""Profiling: counts, pivots, descriptions, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import quantiles


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, by: str, col: str, values: list[str]) -> DataFrame:
    out = df.groupBy(by).agg(*(F.count_if(F.col(col) == v).alias(v) for v in values))
    return out.withColumn("total", reduce(lambda a, b: a + b, (F.col(v) for v in values)))


def describe(df: DataFrame, col: Column, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max."""
    rows = df.select(*(by or []), col.alias("x"))
    plain = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    quartiles = quantiles(rows, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by or [])
    out = rows.groupBy(*by).agg(*plain).join(quartiles, by) if by else rows.agg(*plain).crossJoin(quartiles)  # one row each without groups
    return out.select(*(by or []), "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_all(df: DataFrame) -> DataFrame:
    """A row per column: n, and by kind n_unique, top (of ties the smallest) and freq, or mean, std, min, quartiles and max."""
    numbers = "mean std min q25 q50 q75 max".split()
    out = []
    for c, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            got = describe(df, F.col(c)).select(F.col("n"), *(F.lit(None).cast(t).alias(x) for x, t in (("n_unique", "long"), ("top", "string"), ("freq", "long"))), *(F.col(x).cast("double") for x in numbers))
        else:
            per = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("k"))
            most = F.max(F.col("k"))
            best = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("n_unique"), most.alias("freq"))
            top = per.join(F.broadcast(best.select("freq")), F.expr("k = freq"), "left_semi").agg(F.min("v").alias("top"))  # one row each
            got = best.crossJoin(top).select("n", "n_unique", "top", "freq", *(F.lit(None).cast("double").alias(x) for x in numbers))
        out.append(got.select(F.lit(c).alias("column"), "*"))
    return reduce(DataFrame.unionByName, out)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, low, high, n) for ``bins`` bins of equal width from 0, the last closed; empty ones too. Nulls don't count."""
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = rows.crossJoin(F.broadcast(ends)).select(F.when(F.col("hi") == F.col("lo"), 0).otherwise(b).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # one row
    every = ends.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_size(images: DataFrame, by: str = "category") -> DataFrame:
    """Mean width and height of images per group."""
    return images.groupBy(by).agg(F.avg("width").alias("mean_width"), F.avg("height").alias("mean_height"))


def sample_per_group(df: DataFrame, by: str, n: int, seed: int = 42) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")))))).where(F.col("_r") <= n).drop("_r")

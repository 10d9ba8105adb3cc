"""Writers of features, matches, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_features(features: DataFrame, path: str, individual: bool = False) -> None:
    """Parquet by status, or a folder per item."""
    features.write.mode("overwrite").partitionBy("id" if individual else "status").parquet(path)


def feature_summary(features: DataFrame) -> DataFrame:
    """Presence and width of each vector; 0 where it is missing."""
    wide = lambda c: F.coalesce(F.size(c), F.lit(0))
    return features.select(
        "id", "category", "status", F.col("description").isNotNull().alias("has_description"), F.col("image").isNotNull().alias("has_image_features"),
        F.col("text").isNotNull().alias("has_text_features"), F.when(F.col("image").isNull(), 0).otherwise(wide("image")).alias("image_feature_dim"),
        F.when(F.col("text").isNull(), 0).otherwise(wide("text")).alias("text_feature_dim"),
    )


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dead_letters(features: DataFrame, error: str = "error") -> DataFrame:
    """(id, error) of the items without a vector: their own message where ``features`` has one, else that it is missing."""
    own = F.col(error) if error in features.columns else F.lit(None).cast("string")
    return features.where("image IS NULL").select("id", F.coalesce(own, F.lit("no image features")).alias("error"))


def matches_json(matches: DataFrame) -> DataFrame:
    """A row per lost item: its id and a JSON array of its matches by rank."""
    one = F.sort_array(F.collect_list(F.struct("rank", F.col("found_id").cast("string").alias("found_id"), "similarity")))
    return matches.groupBy("lost_id").agg(F.to_json(one).alias("matches"))


def save_map(entries: DataFrame, path: str) -> None:
    """(key, value: JSON text) as one JSON object, a line per entry, by key: part files that make it up one after the other, written in parallel.

    A small map is one part.
    """
    entry = F.concat(F.to_json(F.struct(F.col("key").cast("string").alias("k"))), F.lit(""))
    line = F.concat(F.expr("substring(j, 6, length(j) - 6)"), F.lit(": "), F.col("value"))
    lines = entries.withColumn("j", entry).select(F.col("key").cast("string").alias("key"), line.alias("line"))
    last = lines.agg(F.max("key").alias("last"))
    body = lines.crossJoin(F.broadcast(last)).select(F.lit(1).alias("o"), "key", F.concat("line", F.when(F.col("key") < F.col("last"), ",").otherwise("")).alias("value"))  # one row
    ends = entries.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "o int, key string, value string")
    body.unionByName(ends).orderBy("o", "key").select("value").write.mode("overwrite").text(path)


def save_matches(matches: DataFrame, path: str) -> None:
    """``{lost_id: [{rank, found_id, similarity}]}``."""
    save_map(matches_json(matches).toDF("key", "value"), path)


def save_ground_truth(truth: DataFrame, path: str) -> None:
    """``{lost_id: found_id}`` at path/map and the details, if there are any, at path/details."""
    value = F.expr("substring(j, 6, length(j) - 6)")
    rows = truth.withColumn("j", F.to_json(F.struct(F.col("found_id").cast("string").alias("k"))))
    save_map(rows.select(F.col("lost_id").alias("key"), value.alias("value")), f"{path}/map")
    if len(truth.columns) > 2:
        save_json(truth, f"{path}/details")


def save_results(matches: DataFrame, settings: str, path: str) -> None:
    """Matches as Parquet, and the settings of the run (JSON) beside them."""
    matches.write.mode("overwrite").parquet(f"{path}/matches")
    matches.sparkSession.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def save_metrics(metrics: DataFrame, path: str) -> None:
    """The comparison as CSV, and each model's metrics as JSON."""
    save_csv(metrics.coalesce(1), f"{path}/comparison")
    save_json(metrics.coalesce(1), f"{path}/metrics")


def _share(n: int, total: int) -> str:
    return f"{n} ({100 * n / total if total else 0:.1f}%)"


def extraction_report(features: DataFrame) -> list[str]:
    """Counts, vector widths, categories and descriptions. What comes to the driver is a row per category."""
    at = features.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "lost").alias("lost"), F.count_if(F.col("status") == "found").alias("found"),
        F.count("description").alias("described"), F.max(F.size("image")).alias("image"), F.max(F.size("text")).alias("text"),
    ).first()
    per = features.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "lost").alias("lost"), F.count_if(F.col("status") == "found").alias("found"))
    out = ["FEATURE EXTRACTION", "=" * 40, f"items: {at['n']}", f"lost: {at['lost']}", f"found: {at['found']}"]
    out += [f"width of {c} vectors: {at[c]}" for c in ("image", "text") if at[c] is not None]
    out += [f"{r['category']}: {r['n']} (lost {r['lost']}, found {r['found']})" for r in per.orderBy("category").collect()]
    return [*out, f"described: {_share(at['described'], at['n'])}"]


def matching_report(stats: dict) -> list[str]:
    lines = ["MATCHING REPORT", "=" * 40]
    return lines + [f"{k.replace('_', ' ')}: {v:.3f}" if isinstance(v, float) else f"{k.replace('_', ' ')}: {v}" for k, v in stats.items()]


def run_report(lost: DataFrame, matches: DataFrame, settings: str, first: int = 5, shown: int = 3) -> list[str]:
    """Settings, coverage, the distribution of scores, and the best matches of the first lost items by id."""
    from ..operators.evaluate import distribution

    n, hit = lost.count(), matches.select("lost_id").distinct().count()
    out = ["MATCHING RESULTS", "=" * 40, f"settings: {settings}", f"lost items: {n}", f"with matches: {_share(hit, n)}", f"without matches: {_share(n - hit, n)}"]
    dist = distribution(matches).first().asDict()
    out += [f"{k}: {v:.3f}" for k, v in dist.items() if k != "n" and v is not None]
    few = lost.select(F.col("id").alias("lost_id")).orderBy("lost_id").limit(first)
    rows = few.join(matches.where(F.col("rank") <= shown), "lost_id", "left").orderBy("lost_id", "rank").collect()  # first x shown at most
    for i, key in enumerate(dict.fromkeys(r["lost_id"] for r in rows), 1):
        own = [r for r in rows if r["lost_id"] == key and r["rank"] is not None]
        out += [f"{i}. lost item {key}", *(f"   {r['rank']}. found {r['found_id']}: {r['similarity']:.3f}" for r in own)]
        out += [] if own else ["   no matches"]
    return out


def ranking_report(matches: DataFrame, lost_id) -> list[str]:
    """One lost item's matches with their scores and confidence."""
    from ..functions.text import confidence

    rows = matches.where(F.col("lost_id") == F.lit(lost_id)).withColumn("label", confidence(F.col("similarity"))).orderBy("rank").collect()  # the best k
    return [f"matches of {lost_id}: {len(rows)}", *(f"{r['rank']}. {r['found_id']}: {r['similarity']:.4f} ({r['label']})" for r in rows)]


def save_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_report(df_one_row: DataFrame, path: str) -> None:
    """The single row of an aggregate as text lines."""
    save_lines(df_one_row.sparkSession, matching_report(df_one_row.first().asDict()), path)

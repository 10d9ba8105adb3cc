"""Items as one DataFrame: from JSON metadata, or from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entries import json_entries

METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "filename", "category", "timestamp", "status", "description")] + [T.StructField("labelled", T.BooleanType())])
MATCH = "rank int, found_id string, similarity double"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items, in parts if it is large. An entry that isn't an item's JSON fails the job."""
    one = F.from_json("text", METADATA, {"mode": "FAILFAST"})
    return json_entries(spark, path).select(one.alias("x")).select("x.*")


def from_metadata(metadata: DataFrame) -> DataFrame:
    """Items of :func:`read_metadata` as the matching wants them: ``ts`` from the ISO text, null (any time goes) where it
    doesn't parse, and ``zoned``, whether it names an offset."""
    zoned = F.coalesce(F.col("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit(False))
    return metadata.withColumns({"ts": F.try_to_timestamp("timestamp"), "zoned": zoned, "labelled": F.coalesce("labelled", F.lit(False))})


def normalize_category(category):
    """One spelling for categories: "computer_mouse" is "computer-mouse"."""
    return F.regexp_replace(category, "_", "-")


def read_matches(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{lost_id: [{rank, found_id, similarity}]}`` as rows (lost_id, rank, found_id, similarity). ``path`` is a file or a folder of parts.

    With ``lines`` there is a line per lost item, as :func:`.sinks.save_matches` writes it, so that one pass is enough.
    """
    kind = "array<struct<rank: int, found_id: string, similarity: double>>"
    return _map(spark, path, kind, lines).select(F.col("key").alias("lost_id"), F.explode("entry").alias("x")).select("lost_id", "x.*")


def read_ground_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{lost_id: found_id}`` as rows; ``lines`` as in :func:`read_matches`."""
    return _map(spark, path, "string", lines).select(F.col("key").alias("lost_id"), F.col("entry").alias("found_id"))


def _map(spark: SparkSession, path: str, kind: str, lines: bool) -> DataFrame:
    if lines:
        line = F.regexp_replace(F.trim("value"), r"(^\{)|(,$)|(\}$)", "")
        text = spark.read.text(path, lineSep="\n").where(F.length(F.trim("value")) > 1).select(line.alias("text"))
    else:
        text = json_entries(spark, path)
    one = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
    return text.select(F.explode(F.from_json(one, f"map<string, {kind}>")).alias("key", "entry"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, image struct); what can't be decoded has a null image's height of -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def image_metadata(images: DataFrame, files: DataFrame) -> DataFrame:
    """Width, height, mode, aspect ratio, channels and size in KB. ``files`` comes from the binaryFile source."""
    mode = F.when(F.col("image.nChannels") == 1, "L").when(F.col("image.nChannels") == 3, "RGB").when(F.col("image.nChannels") == 4, "RGBA")
    meta = images.select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", mode.alias("mode"))
    sizes = files.select("path", (F.col("length") / 1024).alias("size_kb"))
    return meta.join(sizes, "path").withColumn("aspect_ratio", F.col("width") / F.col("height"))


def new_item(spark: SparkSession, description: str, category: str, status: str = "lost", image: DataFrame | None = None) -> DataFrame:
    """One row for an upload, with an id and a timestamp of now. ``image`` (image, one row) is its vector."""
    now = F.current_timestamp()
    row = spark.range(1) if image is None else image.select("image").limit(1)
    return row.select(
        *([] if image is None else ["image"]),
        F.concat(F.lit("NEW_"), F.date_format(now, "yyyyMMdd_HHmmss")).alias("id"), F.lit(category).alias("category"), F.lit(status).alias("status"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(description).alias("description"), F.lit(False).alias("labelled"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, status, ts, image, description, labelled from embeddings, events and part."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    e, v, p = t("embeddings"), t("events").select("event_id", "ts"), t("part").select("p_partkey", "p_name")
    joined = e.join(v, e.vec_id == v.event_id).join(p, p.p_partkey == e.vec_id, "left")
    return joined.select(
        F.col("vec_id").alias("id"), F.col("label").alias("category"), F.when(F.col("vec_id") % 2 == 0, "lost").otherwise("found").alias("status"),
        "ts", F.col("embedding").cast("array<double>").alias("image"), F.col("p_name").alias("description"), F.col("p_name").isNotNull().alias("labelled"),
    )

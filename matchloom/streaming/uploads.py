"""Uploads as a stream (an extension: there is none in the original semantics): each micro-batch is matched with stored items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import Matcher


def match_stream(uploads: DataFrame, stored: str, out: str, checkpoint: str, matcher: Matcher = Matcher(), **trigger) -> StreamingQuery:
    """Starts matching a stream of lost items (id, category, image, and others that ``matcher`` reads) with the found items at ``stored``.

    A batch's matches go to a folder named by its id, which a batch that is run again after a failure overwrites: each upload is
    matched exactly once. The stored items are read anew for each batch, so items added meanwhile are found.
    """

    def match(batch: DataFrame, batch_id: int) -> None:
        found = batch.sparkSession.read.parquet(stored)
        matcher.match(batch, found).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return uploads.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def matches(spark: SparkSession, out: str) -> DataFrame:
    """All batches' matches."""
    return spark.read.parquet(out)

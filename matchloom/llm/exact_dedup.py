"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

A batch is reduced to digests at once, so text is never shuffled. Its groups are anti-joined with the
index by sort-merge (the index side is read in its buckets, without an exchange) and what is new is
appended bucket by bucket.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import lookup, materialize, shared_dir, ship


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` per row: SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = pa.array([hashlib.sha256((t or b"").lower()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary")


class DigestIndex:
    """A table (digest, keep_id, group_size, batch) at ``path``, in ``buckets`` buckets by digest, each sorted.

    Opening a path that has an index continues it, in this session or a later one. ``buckets`` is fixed
    when the index is made: choose it so that a bucket of the final index fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def groups(self, fingerprints: DataFrame) -> DataFrame:
        """The batch's groups of equal digests; the largest doc_id of a group is kept."""
        found = fingerprints.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        # Written first: the optimizer would else push the anti-join below the aggregation, onto every row.
        return materialize(found, "groups")

    def new_groups(self, fingerprints: DataFrame) -> DataFrame:
        """Those of :meth:`groups` that the index doesn't have."""
        return self._unknown(self.groups(fingerprints))

    def _unknown(self, groups: DataFrame) -> DataFrame:
        return groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """One task per bucket writes one sorted file, as rows are dealt by the bucket's own hash."""
        dealt = groups.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        dealt.write.insertInto(self.table)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against itself and the index, and append what is new.

        Returns a row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts in
        the batch the largest doc_id stays, unless an earlier batch had the text: then keep_id is the earlier
        row, none of the batch's rows is kept, and group_size is the size of the group that was indexed first.
        Null texts count as empty ones. A null doc_id stays only if all of its group are null; rows equal in
        text and doc_id are one document given twice and are marked alike.

        ``batch`` names the batch. Adding it again under its name, after a crash at whatever point, appends only
        what is missing and gives the same result; without a name every call is a batch of its own.
        """
        batch = batch or uuid.uuid4().hex
        prints = materialize(digests(docs), "digests")
        groups = self.groups(prints)
        self.append(self._unknown(groups), batch)
        # Copies are counted in this batch, not in that which was indexed first: here a key's rows are hot or not.
        here = groups.select("digest", F.col("group_size").alias("n")).hint("merge")
        sized = here.join(self.rows(), "digest")
        return lookup(prints, sized, "digest", "n", prints.count()).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("batch").eqNullSafe(F.lit(batch)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """:meth:`DigestIndex.add` on a fresh index in the shared folder.

    Null texts count as empty. An empty table gives no rows; columns besides doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    return DigestIndex(spark, f"{shared_dir(spark)}/index", buckets).add(docs)

"""What every operator needs of the cluster: shipped code and written tables in a folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: The folder of each materialized table.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    What runs in them imports it by name, so every operator with Python in its tasks calls this first.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Only a local session may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = Path(tempfile.gettempdir(), "matchloom-checkpoints").as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/matchloom-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, Spark deletes an execution's shuffle files as soon as it has ended.

    Only for what is written or counted at once: what follows reads the written table and never the shuffle,
    not even after losing executors.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str = "rows", **options: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors. ``options`` go to the writer.

    The table is deleted by :func:`drop`, else when the application ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}"
    with shuffles_freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    files, parent = _files(df.sparkSession, path)
    files.deleteOnExit(parent)
    return table


def _files(spark: SparkSession, path: str):
    """The file system of a materialized table, and the table's own folder there."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return parent.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), parent


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        files, parent = _files(df.sparkSession, _written.pop(df))
        files.delete(parent, True)
        files.cancelDeleteOnExit(parent)

"""What these operators need of the cluster: the library's own shipping and written tables, skew-proof joins, names of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import drop, materialize, shared_dir, ship, shuffles_freed

__all__ = ["HOT_ROWS", "HOT_SHARE", "SMALL_ROWS", "drop", "lookup", "materialize", "row_hash", "shared_dir", "ship", "shuffles_freed"]

#: Up to this many rows on the many side, a join treats no key as hot: one task could hold them all.
SMALL_ROWS = 10_000
#: A key is hot if it holds more than 1 / HOT_SHARE of the rows and more than HOT_ROWS: fewer than HOT_SHARE keys can be hot.
HOT_SHARE, HOT_ROWS = 20_000, 1000

def lookup(many: DataFrame, unique: DataFrame, key: str | list[str], count: str, total: int, small: int = SMALL_ROWS) -> DataFrame:
    """Inner join of ``many`` with ``unique`` (one row per ``key``; ``count`` says how many rows of ``many`` it has).

    Hot keys are joined by broadcast: there are fewer than HOT_SHARE of them whatever the input, so the
    broadcast is bounded. The rest is shuffled.
    """
    if total <= small:
        return many.join(unique, key)
    hot = unique.where(F.col(count) > max(HOT_ROWS, total // HOT_SHARE))
    keys = [key] if isinstance(key, str) else key
    cold = many.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(unique, key)
    return cold.unionByName(many.join(F.broadcast(hot), key))


def row_hash(text: str | Column = "text") -> Column:
    """With doc_id this names a row; rows equal in both are one document given twice."""
    return F.xxhash64(F.lit(1), F.col(text) if isinstance(text, str) else text)

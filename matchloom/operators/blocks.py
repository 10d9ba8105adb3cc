"""The best k partners of each row by a score of all pairs, as matrix products of blocks.

Both sides are dealt into blocks by the hash of their id, each category into as many as it needs itself, so that a task holds
two blocks of a bounded number of rows whatever the size of a category; each pair of blocks gives its best k, and these are
ranked once more. What is shuffled grows with rows times blocks of their own category and k, not with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship

#: Rows of a block, and of the strips of a block that are scored at a time.
BLOCK, STRIP = 4096, 512

Score = Callable[[pd.DataFrame, pd.DataFrame], dict[str, np.ndarray]]


def matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a matrix, zeros for null, and which are there."""
    there = vectors.notna().to_numpy()
    if not there.any():
        return np.zeros((len(vectors), 1)), there
    out = np.zeros((len(vectors), len(vectors[there].iloc[0])))
    out[there] = np.stack(vectors[there].to_list())
    return out, there


def units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def distances(a: np.ndarray, b: np.ndarray, power: int = 2) -> np.ndarray:
    """Euclidean, or Manhattan for ``power`` 1, summed dimension by dimension: no cancellation, one matrix held."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        d = np.abs(x[:, None] - y[None, :])
        out += d * d if power == 2 else d
    return np.sqrt(out) if power == 2 else out


def similarities(a: pd.Series, b: pd.Series, method: str = "cosine") -> np.ndarray:
    """Of each vector of ``a`` with each of ``b``; 0 where one is null, and for the cosine where one is zero."""
    (x, has_x), (y, has_y) = matrix(a), matrix(b)
    if x.shape[1] != y.shape[1]:  # one side has no vector at all
        return np.zeros((len(a), len(b)))
    if method == "cosine":
        out = units(x) @ units(y).T
    elif method == "euclidean":
        out = 1 / (1 + distances(x, y))
    elif method == "normalized_euclidean":
        out = np.maximum(0, 1 - distances(units(x), units(y)) / 2)
    else:
        raise ValueError(f"unknown similarity method: {method}")
    return out * (has_x[:, None] & has_y[None, :])


def dealt(lost: DataFrame, found: DataFrame, by: str | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_key``, ``_l`` and ``_f``: rows of a key meet all of the other side where these three are equal.

    Null keys are one key. Where no key has more rows than a block on either side, nothing is dealt; else rows of a key that the other side lacks go.
    """
    key = F.col(by) if by else F.lit(0)
    size = lambda df, n: df.groupBy(key.alias("_k")).agg(F.ceil(F.count("*") / block).alias(n))
    l, f = size(lost, "_nl"), size(found, "_nf")
    if l.select("_nl").unionByName(f.select(F.col("_nf").alias("_nl"))).where("_nl > 1").isEmpty():
        return tuple(df.withColumns({"_key": key, "_l": F.lit(0), "_f": F.lit(0)}) for df in (lost, found))
    # Both sides may come from one table: a row per key, joined where both keys are null too.
    blocks = l.join(f.withColumnRenamed("_k", "_g"), F.expr("_k <=> _g")).drop("_g")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    out = []
    for df, mine, theirs, n, m in ((lost, "_l", "_f", "_nl", "_nf"), (found, "_f", "_l", "_nf", "_nl")):
        rows = df.withColumn("_key", key).join(blocks, F.expr("_key <=> _k"))
        out.append(rows.withColumn(mine, own(n)).withColumn(theirs, every(m)).drop("_k", "_nl", "_nf"))
    return out[0], out[1]


def best_k(lost: DataFrame, found: DataFrame, score: Score, k: int, by: str | None = "category", temporal: bool = False, last_first: bool = False, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(lost_id, found_id, one column per score, rank): each lost row's best ``k`` by the first score of ``score``, falling.

    ``lost`` and ``found`` have id, ``by`` (null matches null), ts for ``temporal``, and what ``score`` reads.
    Pairs of blocks are dealt to ``tasks`` tasks, by default as Spark sees fit. Ties go to the smaller found id, or to the larger one with ``last_first``. A null ts matches any, and so do times of which only one is ``zoned``.
    """
    names = list(score(pd.DataFrame({c: [] for c in lost.columns}), pd.DataFrame({c: [] for c in found.columns})))
    ship(lost.sparkSession)
    time = F.unix_micros(F.col("ts").cast("timestamp")) if temporal else F.lit(0).cast("long")
    far = F.lit(1 << 62)
    left, right = dealt(lost.withColumn("_t", F.coalesce(time, -far)), found.withColumn("_t", F.coalesce(time, far)), by, block)
    kinds = dict(lost.dtypes)["id"], dict(found.dtypes)["id"]

    def block_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["lost_id", "found_id", *names]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        b = b.sort_values("id", ascending=not last_first)
        return pd.concat([strip(a.iloc[i : i + STRIP], b) for i in range(0, len(a), STRIP)])

    def strip(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scores = score(a, b)
        s = scores[names[0]].copy()
        valid = b["_t"].to_numpy()[None, :] >= a["_t"].to_numpy()[:, None]
        if temporal and "zoned" in a and "zoned" in b:
            valid |= b["zoned"].to_numpy()[None, :] != a["zoned"].to_numpy()[:, None]
        s[~valid] = -np.inf
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
        row, col = np.nonzero((s >= least) & (s > -np.inf))
        order = np.lexsort((col, -s[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, col = row[keep], col[keep]
        return pd.DataFrame({"lost_id": a["id"].to_numpy()[row], "found_id": b["id"].to_numpy()[col], **{n: x[row, col] for n, x in scores.items()}})

    schema = f"lost_id {kinds[0]}, found_id {kinds[1]}, " + ", ".join(f"{n} double" for n in names)
    # Both sides may come from one table: a cogroup needs columns of its own for each.
    left, right = (df.toDF(*(f"{c}{side}" for c in df.columns)).toDF(*df.columns) for side, df in (("_a", left), ("_b", right)))
    if tasks:
        left, right = (df.repartition(tasks, "_key", "_l", "_f") for df in (left, right))
    parts = left.groupBy("_key", "_l", "_f").cogroup(right.groupBy("_key", "_l", "_f")).applyInPandas(block_pair, schema)
    tie = F.desc("found_id") if last_first else F.asc("found_id")
    w = Window.partitionBy("lost_id").orderBy(F.desc(names[0]), tie)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

"""Matching as one object: its settings, all items, a single item in either direction, and browsing."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import keyword_vector, statistics
from .blocks import best_k, similarities
from .knn import KnnMatcher
from .match import lookup_metadata
from .pairs import PairClassifier
from .tfidf import TfIdf


def with_text_vectors(items: DataFrame, tfidf: TfIdf) -> DataFrame:
    """``items`` with ``text``: statistics (8), keywords (18) and TF-IDF of the description; zeros without one, as wide."""
    width = 26 + tfidf.max_features
    vec = F.concat(statistics(F.col("description")), keyword_vector(F.col("description")), F.col("tfidf"))
    joined = items.join(tfidf.transform(items.select("id", "description")), "id")
    return joined.withColumn("text", F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.array_repeat(F.lit(0.0), width)).otherwise(vec)).drop("tfidf")


def _swapped(matches: DataFrame) -> DataFrame:
    """Lost and found change places."""
    other = {"lost_id": "found_id", "found_id": "lost_id"}
    return matches.select(*(F.col(other.get(c, c)).alias(c) for c in matches.columns))


def category_guard(lost: DataFrame, found: DataFrame, wanted: bool = True) -> bool:
    """Categories filter only where both sides have any."""
    return wanted and not any("category" not in df.columns or df.where("category IS NOT NULL").isEmpty() for df in (lost, found))


@dataclass(frozen=True)
class Matcher:
    """Settings of a run. "fast" weighs both similarities always and ignores time; "slow" checks time and, where one
    similarity is exactly 0 beside a positive one, takes the other alone. A vector column that items lack leaves the other alone.
    """

    method: str = "fast"
    image_weight: float = 0.6
    text_weight: float = 0.4
    top_k: int = 5
    min_similarity: float = 0.3
    require_category: bool = True
    image_method: str = "cosine"
    text_method: str = "cosine"

    def __post_init__(self):
        if self.method not in ("fast", "slow"):
            raise ValueError(f"unknown matching method: {self.method}")
        known = V.METHODS if self.method == "slow" else ("cosine", "euclidean")
        for m in (self.image_method, self.text_method):
            if m not in known:
                raise ValueError(f"unknown similarity method: {m}")

    def _score(self, columns: list[str]):
        kinds = {c: m for c, m in (("image", self.image_method), ("text", self.text_method)) if c in columns}
        wi, wt, slow = self.image_weight, self.text_weight, self.method == "slow"

        def score(a, b):
            import numpy as np

            parts = {c: similarities(a[c], b[c], m) for c, m in kinds.items()}
            if len(parts) == 1:
                return {"similarity": next(iter(parts.values())), **{f"{c}_similarity": x for c, x in parts.items()}}
            i, t = parts["image"], parts["text"]
            both = wi * i + wt * t
            if slow:
                both = np.where((i == 0) & (t > 0), t, np.where((t == 0) & (i > 0), i, both))
            return {"similarity": both, "image_similarity": i, "text_similarity": t}

        return score

    def match(self, lost: DataFrame, found: DataFrame, k: int | None = None) -> DataFrame:
        """(lost_id, found_id, similarity, image_similarity, text_similarity, rank) of the best ``k`` at or above the minimum; 0 stands for the default."""
        use = [c for c in ("id", "category", "ts", "zoned", "image", "text") if c in lost.columns and c in found.columns]
        by = "category" if category_guard(lost, found, self.require_category) else None
        out = best_k(lost.select(*use), found.select(*use), self._score(use), k or self.top_k or 5, by, self.method == "slow" and "ts" in use)
        return out.where(F.col("similarity") >= self.min_similarity)

    def run(self, items: DataFrame) -> DataFrame:
        """All lost items against all found ones."""
        return self.match(items.where("status = 'lost'"), items.where("status = 'found'"))

    def match_one(self, item: DataFrame, items: DataFrame, status: str = "lost") -> DataFrame:
        """One new item, lost or found, against the items of the other status; time is not checked.

        Columns as in :meth:`match`, ranked from the new item's side.
        """
        other = items.where(F.col("status") == ("found" if status == "lost" else "lost"))
        out = self.match(item.drop("ts"), other.drop("ts"))
        return out if status == "lost" else _swapped(out)

    def settings(self) -> str:
        """The settings as JSON, to go with the results."""
        return json.dumps(asdict(self))


def find_matches(item: DataFrame, items: DataFrame, status: str = "lost", model: str = "similarity", matcher: Matcher = Matcher(), fitted: KnnMatcher | PairClassifier | None = None) -> DataFrame:
    """Matches of one new item by a model, with the metadata of what it is matched to.

    The learned models have no minimum, keep only items with metadata, and follow ``status`` as the similarity does.
    """
    if model not in ("similarity", "knn", "svm"):
        raise ValueError(f"unknown model: {model}")
    if model == "similarity":
        found = matcher.match_one(item, items, status)
        return lookup_metadata(found, items) if status == "lost" else found
    if fitted is None:
        raise ValueError(f"the model {model} isn't fitted")
    other = items.where(F.col("status") == ("found" if status == "lost" else "lost"))
    if model == "knn":
        if status != "lost" or fitted.found is None:  # neighbours among lost items need a scaler of their own; the caller's stays as it is
            fitted = KnnMatcher(fitted.n, fitted.metric, fitted.prefilter).fit(other, fitted.col)
        found = fitted.predict(item)
    else:
        both = item.withColumn("status", F.lit("lost")).unionByName(other.withColumn("status", F.lit("found")), allowMissingColumns=True)
        found = fitted.predict(both, 5)
    found = lookup_metadata(found.select("lost_id", "found_id", "similarity", "rank"), items, keep_unknown=False)
    return found if status == "lost" else _swapped(found)


def matches_for(matches: DataFrame, lost_id) -> DataFrame:
    """One lost item's matches by rank."""
    return matches.where(F.col("lost_id") == F.lit(lost_id)).orderBy("rank")


def browse(items: DataFrame, matches: DataFrame | None = None, model: str = "similarity", category: int | str | None = None, minimum: float = 0.0, matcher: Matcher = Matcher(), fitted: KnnMatcher | PairClassifier | None = None) -> DataFrame:
    """Matches to show: those given, or computed anew (the classifier's best ten); of one category, from a score on, with metadata."""
    if matches is None:
        if model == "similarity":
            matches = matcher.run(items)
        elif fitted is None:
            raise ValueError(f"the model {model} isn't fitted")
        else:
            matches = fitted.predict(items.where("status = 'lost'")) if model == "knn" else fitted.predict(items, 10)
    shown = lookup_metadata(matches.where(F.col("similarity") >= minimum), items, keep_unknown=False)
    if category is None:
        return shown.join(items.select(F.col("id").alias("lost_id")), "lost_id", "left_semi")
    return shown.join(items.where(F.col("category") == F.lit(category)).select(F.col("id").alias("lost_id")), "lost_id", "left_semi")


def pages(n: Column, size: int) -> Column:
    """The number of pages of ``size`` that ``n`` entries fill."""
    return F.ceil(n / size).cast("long")

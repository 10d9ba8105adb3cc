"""Columns over ``array<double>`` vectors. Null operands give a similarity of 0, zero vectors too; NaN never arises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return F.coalesce(F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.coalesce(1 / (1 + distance(a, b)), F.lit(0.0))


def normalized_euclidean(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance(unit(a), unit(b)) / 2), F.lit(0.0))


METHODS = {"cosine": cosine, "euclidean": euclidean, "normalized_euclidean": normalized_euclidean}


def similarity(method: str, a: Column, b: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown similarity method: {method}")
    return METHODS[method](a, b)


def knn_distance(metric: str, a: Column, b: Column) -> Column:
    """Distances of nearest-neighbour search; the cosine one is 1 - cosine."""
    kinds = {"cosine": lambda: 1 - cosine(a, b), "euclidean": lambda: distance(a, b), "manhattan": lambda: manhattan(a, b)}
    if metric not in kinds:
        raise ValueError(f"unknown metric: {metric}")
    return kinds[metric]()


def pair_features(a: Column, b: Column) -> Column:
    """a, b, |a - b| and a * b, one after the other."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def combined(image: Column, text: Column, image_weight: float = 0.6, text_weight: float = 0.4, fallback: bool = True) -> Column:
    """Weighted sum; with ``fallback`` a similarity of exactly 0 beside a positive one leaves the other alone."""
    both = image_weight * image + text_weight * text
    if not fallback:
        return both
    return F.when((image == 0) & (text > 0), text).when((text == 0) & (image > 0), image).otherwise(both)


def combine_vectors(image: Column, text: Column) -> Column:
    return F.concat(image, text)

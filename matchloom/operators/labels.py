"""Heuristic labels: a pair score from text and keyword overlap, and the best found item per lost one."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import materialize, ship
from ..functions.text import clean_words, overlap, quality, truncate
from .allpairs import Distinct, Strips, common, overlaps, rounded
from .match import candidates, rank

# Phrases of the label heuristic's first version, by kind.
PHRASES = {
    "colors": ("red", "blue", "black", "white", "green", "yellow", "orange", "purple", "pink", "brown", "grey", "gray", "navy", "dark", "light", "tan", "beige", "maroon", "olive", "camouflage", "camo", "multicolor"),
    "brands": ("nike", "adidas", "jansport", "under armour", "targus", "head", "musto", "jack wolfskin", "hello kitty", "disney", "scooby", "strawberry shortcake", "hedgren", "majestic", "texas instruments", "casio", "apple", "samsung", "sony", "hp", "dell"),
    "materials": ("leather", "fabric", "canvas", "nylon", "denim", "plastic", "metal", "wood", "glass", "rubber", "cotton", "polyester"),
    "features": ("backpack", "bag", "satchel", "messenger", "hiking", "laptop", "zippered", "compartment", "pocket", "strap", "buckle", "flap", "wallet", "book", "calculator", "mouse", "earphones", "headphones", "glasses", "sunglasses", "keys", "keychain", "water bottle", "bottle", "id card", "card"),
    "sizes": ("small", "large", "medium", "big", "compact", "mini"),
}
# Phrases of its second version, by kind.
PHRASES_2 = {
    "colors": ("red", "blue", "black", "white", "green", "yellow", "orange", "purple", "pink", "brown", "grey", "gray", "navy", "dark", "light", "tan", "beige", "maroon", "olive"),
    "brands": ("nike", "adidas", "jansport", "under armour", "targus", "head", "musto", "jack wolfskin", "hello kitty", "disney"),
    "materials": ("leather", "fabric", "canvas", "nylon", "denim"),
    "features": ("backpack", "bag", "satchel", "messenger", "hiking", "laptop", "zippered", "compartment", "pocket", "strap"),
}

#: Characters that are counted one by one.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; it depends on the order of its operands. Equal pairs of a batch are compared once."""
    ship(SparkSession.active())
    return _ratio(a, b)


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS and, last, anything else occurs."""
    counts = F.transform(F.array(*map(F.lit, LETTERS)), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.concat(counts, F.array(F.length(text) - F.aggregate(counts, F.lit(0), lambda s, x: s + x)))


def ratio_bound(a: Column, b: Column) -> Column:
    """What :func:`sequence_ratio` can't exceed, from two :func:`letter_counts`: no character is matched twice."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    both = total(a) + total(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / both)


def phrases(text: Column, kind: str, lists: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """Phrases of a kind that occur anywhere in the text, also inside words."""
    return F.filter(F.array(*map(F.lit, lists[kind])), lambda k: F.instr(text, k) > 0)


def with_phrases(items: DataFrame, version: int = 1) -> DataFrame:
    """``items`` with ``cleaned`` and ``phrases`` of the description, once per item; null without one."""
    lists = PHRASES if version == 1 else PHRASES_2
    cleaned = items.withColumn("cleaned", F.when(F.col("description").isNotNull(), clean_words(F.col("description"))))
    return cleaned.withColumn("phrases", F.struct(*(phrases(F.col("cleaned"), k, lists).alias(k) for k in lists)))


def score(version: int = 1, text: Column | None = None) -> Column:
    """Score of a pair of :func:`with_phrases` items under equal categories; 0 if either has no description.

    It never falls where ``text``, by default the sequence ratio of both, grows.
    """
    text = sequence_ratio(F.col("lost_cleaned"), F.col("found_cleaned")) if text is None else text
    part = lambda k: (F.col(f"lost_phrases.{k}"), F.col(f"found_phrases.{k}"))
    share = lambda k: overlap(*part(k))
    any_ = lambda k, v: F.when(F.size(F.array_intersect(*part(k))) > 0, v).otherwise(0.0)
    if version == 1:
        s = 0.25 * text + 0.25 * share("colors") + 0.25 * any_("brands", 1.0) + 0.10 * share("materials") + 0.10 * share("features") + 0.05 * any_("sizes", 0.5)
        s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s + F.when(text > 0.7, 0.1).otherwise(0.0)))
    else:
        s = 0.30 * text + 0.25 * share("colors") + 0.25 * any_("brands", 1.0) + 0.10 * share("materials") + 0.10 * share("features")
    return F.when(F.col("lost_description").isNull() | F.col("found_description").isNull(), 0.0).otherwise(s)


def _pairs(items: DataFrame, version: int) -> DataFrame:
    """Pairs of a category with ``upper``, what their score can't exceed."""
    rows = items.withColumn("letters", letter_counts(F.col("cleaned"))).drop("description", "cleaned").withColumn("description", F.col("letters").isNotNull())
    described = rows.withColumn("description", F.when(F.col("description"), True))
    return candidates(described).withColumn("upper", score(version, ratio_bound(F.col("lost_letters"), F.col("found_letters")))).select("lost_id", "found_id", "upper")


def _scored(pairs: DataFrame, items: DataFrame, version: int) -> DataFrame:
    """(lost_id, found_id, similarity) of ``pairs`` (lost_id, found_id) by the sequence ratio itself."""
    named = lambda side: items.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("description", "cleaned", "phrases")))
    return pairs.join(named("lost"), "lost_id").join(named("found"), "found_id").select("lost_id", "found_id", score(version).alias("similarity"))


def ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    """:func:`sequence_ratio` of each text of ``a`` with each of ``b``; null is the empty text."""
    out = np.empty((len(a), len(b)))
    for j, y in enumerate(b):
        matcher = difflib.SequenceMatcher(None, "", y or "")
        for i, x in enumerate(a):
            matcher.set_seq1(x or "")
            out[i, j] = matcher.ratio()
    return out


def pair_ratios(a: pd.DataFrame, b: pd.DataFrame) -> Strips:
    """Of (cleaned), for :func:`.allpairs.all_pairs`: the ratio once for different texts of two blocks."""
    d = Distinct(a, b, "cleaned")
    s = ratios(d.a["cleaned"], d.b["cleaned"])
    return lambda i, j: {"ratio": d.strip(s, i, j)}


def pair_scores(version: int = 1) -> Callable[[pd.DataFrame, pd.DataFrame], Strips]:
    """:func:`score`, rounded, of :func:`with_phrases` items, once for different texts of two blocks."""

    def scores(a: pd.DataFrame, b: pd.DataFrame) -> Strips:
        d = Distinct(a, b, "cleaned")
        sets = lambda kind: ([p[kind] for p in d.a["phrases"]], [p[kind] for p in d.b["phrases"]])
        share = lambda kind: overlaps(*sets(kind))
        any_ = lambda kind, v: np.where(common(*sets(kind))[0] > 0, v, 0.0)
        text = ratios(d.a["cleaned"], d.b["cleaned"])
        if version == 1:
            s = 0.25 * text + 0.25 * share("colors") + 0.25 * any_("brands", 1.0) + 0.10 * share("materials") + 0.10 * share("features") + 0.05 * any_("sizes", 0.5)
            s = np.minimum(1.0, np.maximum(0.0, s + np.where(text > 0.7, 0.1, 0.0)))
        else:
            s = 0.30 * text + 0.25 * share("colors") + 0.25 * any_("brands", 1.0) + 0.10 * share("materials") + 0.10 * share("features")
        described = d.a["cleaned"].notna().to_numpy()[:, None] & d.b["cleaned"].notna().to_numpy()[None, :]
        s = rounded(np.where(described, s, 0.0))
        return lambda i, j: {"score": d.strip(s, i, j)}

    return scores


def _distinct(items: DataFrame) -> DataFrame:
    """The item of smallest id of each category, status and cleaned description; those without a description never match."""
    alike = items.where("cleaned IS NOT NULL").groupBy("category", "status", "cleaned")
    return alike.agg(F.min("id").alias("id"), F.min_by("phrases", "id").alias("phrases"), F.min_by("description", "id").alias("description"))


def best_pairs(items: DataFrame, version: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The best pair per lost item of :func:`with_phrases` items, and the pairs whose sequence ratio had to be taken for it.

    Items of one category and cleaned description have the same scores, so the search is over one of each: the smallest found
    id stands for its likes, as it wins their ties, and a lost item's answer goes to all of its likes.

    Filter and verify: bounds come from lengths and character counts. The ratio is taken for each lost item's pair of the
    highest bound, then for those whose bound reaches what that gave. A bound under ``least`` needs none.
    """
    every, items = items, materialize(_distinct(items), "distinct")
    possible = _pairs(items, version).where((F.col("upper") > 0) & (F.col("upper") >= least))
    highest = possible.groupBy("lost_id").agg(F.max_by("found_id", "upper").alias("found_id"))
    first = materialize(_scored(highest, items, version), "first")
    seen = first.select("lost_id", F.col("found_id").alias("seen"), F.col("similarity").alias("reached"))
    others = possible.join(seen, "lost_id").where((F.col("upper") >= F.col("reached")) & (F.col("found_id") != F.col("seen"))).select("lost_id", "found_id")
    verified = first.unionByName(_scored(others, items, version))
    best = rank(verified, 1).where((F.col("similarity") > 0) & (F.col("similarity") >= least))
    kinds = items.where("status = 'lost'").select(F.col("id").alias("lost_id"), F.col("category").alias("_c"), F.col("cleaned").alias("_t"))
    alike = every.where("status = 'lost'").select("id", "category", "cleaned").join(best.join(kinds, "lost_id").drop("lost_id"), F.expr("category <=> _c AND cleaned = _t"))
    best = alike.select(F.col("id").alias("lost_id"), *(c for c in best.columns if c != "lost_id"))
    return best, first.select("lost_id", "found_id").unionByName(others)


def ground_truth(items: DataFrame, version: int = 1, minimum: float | None = None) -> DataFrame:
    """The best found item per lost item; the first by id wins ties, scores of 0 never match.

    Version 1 takes labelled items, 0.35 as the least score, and shortens long descriptions; version 2 takes all items, 0.75,
    and cuts every description to 80 characters.
    """
    least = minimum if minimum is not None else 0.35 if version == 1 else 0.75
    rows = items.where("labelled") if version == 1 else items
    rows = with_phrases(rows.select("id", "category", "status", "description"), version)
    named = lambda side: rows.select(F.col("id").alias(f"{side}_id"), F.col("category").alias(f"{side}_category"), F.col("description").alias(f"{side}_description"))
    best = best_pairs(rows, version, least)[0].join(named("lost"), "lost_id").join(named("found"), "found_id")
    short = lambda c: truncate(F.col(c)) if version == 1 else truncate(F.col(c), 80, True)
    return best.select(
        "lost_id", "found_id", F.round("similarity", 3).alias("confidence"), F.col("lost_category").alias("category"),
        short("lost_description").alias("lost_desc"), short("found_description").alias("found_desc"), quality(F.col("similarity")).alias("quality"),
    )

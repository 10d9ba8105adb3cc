"""Text features as columns: cleaning, keywords, statistics and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the text vector, by class in the vector's order.
KEYWORDS = {
    "colors": ("red", "blue", "green", "yellow", "black", "white", "gray", "grey", "brown", "pink", "purple", "orange", "cyan", "magenta", "beige", "navy", "maroon", "gold", "silver", "bronze", "cream", "tan"),
    "materials": ("leather", "plastic", "metal", "wood", "fabric", "cotton", "polyester", "nylon", "rubber", "silicon", "glass", "paper", "cardboard", "denim", "canvas", "wool", "synthetic", "aluminum", "steel", "brass"),
    "conditions": ("new", "old", "used", "worn", "damaged", "scratched", "broken", "torn", "pristine", "excellent", "good", "fair", "poor", "vintage", "antique"),
    "sizes": ("small", "medium", "large", "tiny", "huge", "big", "little", "mini", "compact", "oversized", "xl", "xs", "xxl"),
    "brands": ("apple", "samsung", "nike", "adidas", "hp", "dell", "lenovo", "asus", "sony", "lg", "microsoft", "logitech", "razer", "casio", "texas", "moleskine", "leuchtturm", "pilot", "uni", "sharpie"),
}
# Words that the word counts of profiles leave out.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "it", "its", "this", "that", "these", "those")
# Single keywords with a place of their own in the text vector.
ONE_HOT = {"colors": ("red", "blue", "black", "white", "green"), "materials": ("leather", "plastic", "metal")}
# White space of any script; Java's \s and RE2's are ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def clean(text: Column) -> Column:
    """Lower-cased; all but a-z, 0-9, white space and hyphens becomes a space; white space collapsed. Null gives ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s\-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def clean_words(text: Column) -> Column:
    """Lower-cased; all but letters, digits and _ of any script becomes a space; white space collapsed."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Tokens between white space of any script; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def known(words: Column, kind: str) -> Column:
    """Sorted keywords of a class among ``words``."""
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, KEYWORDS[kind]))))


def keywords(text: Column, kind: str) -> Column:
    """Sorted keywords of a class among the clean text's tokens."""
    return known(F.split(clean(text), " "), kind)


def keyword_sets(text: Column) -> Column:
    """A struct of all classes' keywords, to be made once per item, before any join."""
    return F.transform(F.array(F.split(clean(text), " ")), lambda w: F.struct(*(known(w, k).alias(k) for k in KEYWORDS)))[0]


def keyword_vector(text: Column) -> Column:
    """18 numbers: presence and count per class, then single colors and materials."""

    def numbers(sets: Column) -> Column:
        out = []
        for kind in KEYWORDS:
            n = F.size(sets[kind]).cast("double")
            out += [(n > 0).cast("double"), n]
        for kind, names in ONE_HOT.items():
            out += [F.array_contains(sets[kind], w).cast("double") for w in names]
        return F.array(*out)

    return F.transform(F.array(keyword_sets(text)), numbers)[0]


def statistics(text: Column) -> Column:
    """8 numbers: characters, words, mean word length, words over 6, digits, upper case, ! and ?, share of distinct words."""
    t = F.coalesce(text, F.lit(""))
    w = tokens(t)
    n = F.size(w).cast("double")
    some = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    return F.array(
        F.length(t).cast("double"),
        n,
        some(F.aggregate(w, F.lit(0.0), lambda a, x: a + F.length(x))),
        F.size(F.filter(w, lambda x: F.length(x) > 6)).cast("double"),
        F.regexp_count(t, F.lit(r"\p{Nd}")).cast("double"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"),
        F.regexp_count(t, F.lit(r"[!?]")).cast("double"),
        some(F.size(F.array_distinct(w)).cast("double")),
    )


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common entries over the larger set's size; 0 if both are empty."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def keyword_similarity(a: Column, b: Column) -> Column:
    """Mean over the classes of the Jaccard similarity of two :func:`keyword_sets`."""
    parts = [jaccard(a[k], b[k]) for k in KEYWORDS]
    return sum(parts[1:], parts[0]) / len(parts)


def ngram_profile(text: Column, n: int = 2, top: int = 50) -> Column:
    """Counts of the ``top`` most frequent character n-grams over their sum, falling, padded with zeros.

    Equal n-grams are counted as runs of the sorted list: n log n for a text of any length.
    """
    t = clean(text)
    grams = F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    ordered = F.transform(F.array(F.array_sort(grams)), lambda g: F.filter(F.transform(g, lambda x, i: F.when((i == 0) | (x != F.get(g, i - 1)), i)), lambda i: i.isNotNull()))[0]
    whole_size = F.greatest(F.length(t) - (n - 1), F.lit(0))
    counts = F.transform(F.array(ordered), lambda at: F.transform(at, lambda x, i: (F.coalesce(F.get(at, i + 1), whole_size) - x).cast("double")))[0]
    first = F.slice(F.reverse(F.array_sort(counts)), 1, top)
    return F.transform(F.array(first), lambda c: _shares(c, top))[0]


def _shares(counts: Column, top: int) -> Column:
    whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.concat(F.transform(counts, lambda x: x / whole), F.array_repeat(F.lit(0.0), F.lit(top) - F.size(counts)))


def truncate(text: Column, size: int = 100, always: bool = False) -> Column:
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return cut if always else F.when(F.length(text) > size, cut).otherwise(text)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "Very High").when(score >= 0.6, "High").when(score >= 0.4, "Medium").otherwise("Low")


def confidence_short(score: Column) -> Column:
    return F.when(score >= 0.7, "High").when(score >= 0.5, "Medium").otherwise("Low")


def quality(score: Column) -> Column:
    return F.when(score > 0.6, "high").when(score > 0.45, "medium").otherwise("reasonable")


def first_score(similarity: Column, combined: Column) -> Column:
    """The first that is neither null nor 0, else 0."""
    return F.when(similarity.isNotNull() & (similarity != 0), similarity).otherwise(F.coalesce(combined, F.lit(0.0)))


def temporal_valid(found: Column, lost: Column) -> Column:
    """True unless both ISO times parse, agree in having an offset, and found is earlier."""
    zone = r"(Z|[+-]\d\d:?\d\d)$"
    alike = found.rlike(zone) == lost.rlike(zone)
    return F.coalesce(~alike | (F.try_to_timestamp(found) >= F.try_to_timestamp(lost)), F.lit(True))


def date_prefix(timestamp: Column) -> Column:
    """The date of an ISO timestamp in text."""
    return F.substring(timestamp, 1, 10)

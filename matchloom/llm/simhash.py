"""Near-duplicates by SimHash fingerprints under a covering locality-sensitive hash.

The 64 bit positions get the non-zero vectors of GF(2)^(r+1) in turn. Table v keeps the bits whose vector
has odd product with v. Up to r differing positions span at most r dimensions, so some v is orthogonal
to all of them: in that table both fingerprints have the same key. So no pair within radius r is missed.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import lookup, materialize, row_hash, ship
from .components import connected_components
from .line_dedup import BANDS, hashed_keys, verified_roots

#: Distinct fingerprints that one task compares directly; larger buckets are split by the pigeonhole principle.
DIRECT = 32_768
#: Texts that one task compares with each other by their shingles.
SIMILAR_DIRECT = 500


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included, as a signed long."""
    return simhash_of(word_shingles(text, shingle))


def word_shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles in order; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), "<u8", n)


def simhash_of(hashes: np.ndarray) -> int:
    """Zero for no hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, rh, fp)`` per row; rh is :func:`.cluster.row_hash`."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["doc_id", "rh", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_hash().alias("rh"), "text").mapInArrow(run, "doc_id long, rh long, fp long")


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes held as bytes, as :func:`.line_dedup.shingle_hashes` gives them."""
    n = np.array([len(x) // 8 for x in items])
    return np.frombuffer(b"".join(items), "<u8"), np.cumsum(n) - n, n


def _banded(docs: DataFrame, shingle: int) -> DataFrame:
    """:func:`fingerprints` with the keys b0, b1, ... of each text's MinHash bands, null for a text without words."""
    ship(docs.sparkSession)
    names = [f"b{i}" for i in range(BANDS)]

    def run(batches):
        for batch in batches:
            fps, keys = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                h = word_shingles(text, shingle)
                fps.append(simhash_of(h))
                keys.append(hashed_keys(h, np.array([0]), np.array([len(h)]))[0].view(np.int64).tolist() if len(h) else [None] * BANDS)
            cols = list(zip(*keys)) if keys else [()] * BANDS
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "rh", "fp", *names])

    schema = "doc_id long, rh long, fp long" + "".join(f", {b} long" for b in names)
    return docs.select(F.col("doc_id").cast("long"), row_hash().alias("rh"), "text").mapInArrow(run, schema)


def similar_links(docs: DataFrame, prints: DataFrame, shingle: int, direct: int = SIMILAR_DIRECT) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints of texts whose sets of shingles have a Jaccard similarity of 0.8 and more.

    Candidates share one of the bands of line_dedup, so a pair at the threshold is missed with probability 0.005;
    every link rests on the exact similarity. ``prints`` is what :func:`_banded` gives. Equal texts are one node.
    """
    bands = [F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)]
    nodes = prints.where("b0 IS NOT NULL").groupBy(F.col("rh").alias("lid")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("fp").alias("fp"), *bands)
    nodes = materialize(nodes, "nodes")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lines = [word_shingles(t, shingle).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.binary())], ["lid", "line"])

    def texts_of(wanted: DataFrame) -> DataFrame:
        # The row with the smallest doc_id stands for all rows of a text, so that no text's copies meet in a task.
        one = nodes.join(wanted, "lid").select("lid", "first").hint("shuffle_hash")
        rows = docs.select(F.col("doc_id").cast("long").alias("k"), row_hash().alias("h"), "text")
        return rows.join(one, F.expr("k <=> first AND h = lid")).select("lid", "text").mapInArrow(run, "lid long, line binary").dropDuplicates(["lid"])

    found = verified_roots(nodes, texts_of, direct, _packed).toDF("a", "b")
    fps = nodes.select("lid", "fp")
    both = found.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b")
    return both.select(F.col("fa").alias("a"), F.col("fb").alias("b")).where("a != b")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits are all outside one of them."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def linked(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star for each component within ``fps`` (distinct): (smallest, other)."""
    unseen, out = np.sort(fps), []
    while len(unseen) > 1:
        first, unseen = unseen[0], unseen[1:]
        queue = [first]
        while queue and len(unseen):
            near = np.bitwise_count((unseen ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                hit = unseen[near]
                out += [(int(first), int(x)) for x in hit]
                queue += list(hit)
                unseen = unseen[~near]
    return out


def _edges(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            pairs = [p for fps in batch.column(0).to_pylist() for p in linked(np.array(fps, np.int64), radius)]
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 3, direct: int = DIRECT) -> DataFrame:
    """Edges ``(a, b)`` with the same components as all pairs of ``distinct.fp`` within ``radius`` bits; linear in number.

    A bucket of more than ``direct`` fingerprints is dealt again: its bits that may still differ go into
    radius + 1 parts, and a pair within the radius agrees on one of them. Three such levels leave so few free
    bits that a bucket's size is bounded whatever the input.
    """
    tables = [F.struct(F.lit(signed(m)).alias("mask"), F.lit(signed(~m & (2**64 - 1))).alias("free")) for m in covering_masks(radius)]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.free", F.xxhash64("t.mask", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("k"))
    edges, parts = None, radius + 1
    for level in range(4):
        sizes = keyed.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
        keyed = materialize(keyed.join(sizes, "k"), f"level{level}")
        small = keyed if level == 3 else keyed.where(F.col("size") <= direct)
        found = _edges(small.groupBy("k").agg(F.collect_list("fp").alias("fps")), radius)
        edges = found if edges is None else edges.unionByName(found)
        large = keyed.where(F.col("size") > direct)
        if level == 3 or large.isEmpty():
            return edges
        # Bit i goes to part (i // parts^level) % parts.
        groups = [signed(sum(1 << i for i in range(64) if i // parts**level % parts == j)) for j in range(parts)]
        split = large.select("fp", "free", "k", F.explode(F.array(*map(F.lit, groups))).alias("g"))
        same = F.col("free").bitwiseAND(F.col("g"))
        keyed = split.select(
            "fp", F.col("free").bitwiseAND(F.bitwise_not(F.col("g"))).alias("free"), F.xxhash64("k", same, F.col("fp").bitwiseAND(same)).alias("k")
        )


def _components(docs: DataFrame, radius: int, shingle: int, direct: int, similar: bool = False) -> DataFrame:
    """``(doc_id, rh, fp, component_id)`` per row; ``similar`` adds the links of :func:`similar_links`."""
    prints = materialize(_banded(docs, shingle) if similar else fingerprints(docs, shingle), "fingerprints")
    total = prints.count()
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    edges = links(nodes.select("fp"), radius, direct)
    if similar:
        edges = edges.unionByName(similar_links(docs, prints, shingle))
        prints = prints.select("doc_id", "rh", "fp")
    roots = connected_components(edges)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    tops = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    named = lookup(rooted, tops, "root", "nodes", total)
    return lookup(prints, named.select("fp", "n", "component_id"), "fp", "n", total)


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3, direct: int = DIRECT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach. Null and empty
    texts have fingerprint zero and link like any other. Null doc_ids are never the smallest: component_id is
    null only where a component has no other. Repeated rows each give a row. Equal fingerprints are one node,
    so copies cost nothing beyond a count. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = _components(docs, radius, shingle, direct)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = 3, shingle: int = 5, direct: int = DIRECT, similar: bool = False) -> DataFrame:
    """The rows of ``docs``, with their columns, whose doc_id is their component's smallest.

    Rows equal in doc_id and text are one document given twice, and one of them stays; so does each different
    text with the same smallest doc_id. A component of null doc_ids only keeps its different texts.
    ``similar`` also links texts by :func:`similar_links`. An empty table stays empty; columns may have any names.
    """
    found = materialize(_components(docs, radius, shingle, direct, similar).select("doc_id", "rh", "component_id"), "components")
    keys = found.groupBy("doc_id", "rh").agg(F.count("*").alias("times"), F.first("component_id").alias("component_id")).where("component_id <=> doc_id")
    keys = keys.select(F.col("doc_id").alias("d"), F.col("rh").alias("r"), "times").hint("shuffle_hash")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("k"), row_hash().alias("h"))
    kept = rows.join(keys, F.expr("k <=> d AND h = r"))
    once = kept.where("times = 1").select("row.*")
    if found.groupBy("doc_id", "rh").count().where("count > 1").isEmpty():
        return once
    return once.unionByName(kept.where("times > 1").dropDuplicates(["k", "h"]).select("row.*"))

"""Embedding near-dedup: tiles of vectors in the order of their principal components, compared dimension group by dimension group.

Equal vectors count as one with a weight. Vectors are rotated onto principal components, dealt into blocks along the leading
ones, and blocks whose boxes lie too far apart for any pair never meet. Where two blocks meet, products of the leading dimensions
are accumulated; what the others can add is at most the product of both suffixes' norms, so rows that can't reach the
threshold any more are left out of the next group of dimensions. What remains is compared in double precision.

A tile gives no pairs: per vector the weight it links to, and as edges a spanning forest of the links between both
blocks' components, so a group of near copies costs an edge per pair of blocks and not one per pair of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import drop, lookup, materialize, ship
from .components import connected_components

#: Vectors of a block, and of the strips it is compared in.
BLOCK, STRIP = 4096, 1024
#: Numbers of a block at most: 32 MB.
NUMBERS = 1 << 22
#: Vectors the principal components are fitted on: those of smallest hash. They order the work and change no result.
SAMPLE = 4096
#: Dimensions after which rows are left out.
STEPS = (16, 32)
#: What single precision may be wrong by, and what double precision may be by another order of adding.
LOOSE, TIGHT = 1e-4, 1e-9


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1, by their largest part first so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def components_of(sample: np.ndarray) -> np.ndarray:
    """Principal axes of the unit vectors ``sample``, as columns by falling variance."""
    if not len(sample):
        return np.zeros((0, 0))
    centred = unit_rows(sample)
    values, axes = np.linalg.eigh(centred.T @ centred / len(centred))
    return axes[:, ::-1]


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and the matrix that says which of them reach ``threshold``. Both are unit rows on principal axes."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    for k in STEPS:
        if k >= a.shape[1] or not len(rows) or not len(cols):
            break
        # The suffixes' norms as one more dimension: the product is the bound.
        x, y = a[rows], b[cols]
        bound = np.column_stack([x[:, :k], np.sqrt((x[:, k:] ** 2).sum(1))]).astype(np.float32) @ np.column_stack([y[:, :k], np.sqrt((y[:, k:] ** 2).sum(1))]).astype(np.float32).T
        there = bound >= np.float32(threshold - LOOSE)
        rows, cols = rows[there.any(1)], cols[there.any(0)]
    if not len(rows) or not len(cols):
        return rows[:0], cols[:0], np.zeros((0, 0), bool)
    cosine = a[rows] @ b[cols].T
    hit = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < TIGHT)):
        hit[i, j] = math.fsum(a[rows[i]] * b[cols[j]]) >= threshold
    r, c = hit.any(1), hit.any(0)
    return rows[r], cols[c], hit[r][:, c]


def forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links in ``hit`` connect, between the names ``left`` of its rows and ``right`` of its columns."""
    names, inner = np.unique(np.concatenate([left, right]), return_inverse=True)
    out, new = [], np.ones(len(names), bool)
    l, r = inner[: len(left)], inner[len(left) :]
    for i in range(len(left)):
        if not new[l[i]]:
            continue
        new[l[i]], grown = False, [l[i]]
        front = np.array([l[i]])
        while len(front):  # each name is in front once
            mark = np.zeros(len(names), bool)
            mark[r[hit[mark_rows(l, front, len(names))].any(0)]] = True
            mark[l[hit[:, mark_rows(r, front, len(names))].any(1)]] = True
            front = np.flatnonzero(mark & new)
            new[front] = False
            grown += front.tolist()
        out += [(int(names[grown[0]]), int(names[g])) for g in grown[1:]]
    return out


def mark_rows(names: np.ndarray, front: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n, bool)
    mark[front] = True
    return mark[names]


def compare(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked to by the rows of ``a`` and of ``b``, and edges between the names ``na`` and ``nb``. ``same``: b is a."""
    to_a, to_b, edges = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
    for i in range(0, len(a), STRIP):
        for j in range(i if same else 0, len(b), STRIP):
            rows, cols, hit = linked(a[i : i + STRIP], b[j : j + STRIP], threshold)
            if not len(rows):
                continue
            rows, cols = rows + i, cols + j
            if same and i == j:
                hit = hit & (rows[:, None] != cols[None, :])
                to_a[rows] += hit @ wb[cols]
            else:
                to_a[rows] += hit @ wb[cols]
                to_b[cols] += hit.T @ wa[rows]
            edges += [e for e in forest(hit, na[rows], nb[cols]) if e[0] != e[1]]
    return to_a, to_b, edges


def roots(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """For 0 to n - 1, the smallest number that ``edges`` connect it to."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64)


def _tables(rows: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of distinct vectors ``rows`` (v, low, n): the nodes (node, v, low, n), their linked weights, and the edges, each in parts."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = size["dims"] or 0
    block = max(1, min(block, NUMBERS // max(1, dims)))
    parts = max(1, math.ceil(size["n"] / block))
    sample = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(max(1, min(SAMPLE, NUMBERS // (4 * max(1, dims))))).select("v").collect()  # 8 MB at most
    padded = np.zeros((len(sample), dims))
    for r, x in zip(padded, sample):
        r[: len(x["v"])] = x["v"]
    axes = components_of(padded)
    lead = min(3, dims)
    cell = math.sqrt(2 - 2 * threshold)

    def rotated(column: pa.Array) -> np.ndarray:
        sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
        if (sizes == dims).all():
            out = flat.reshape(-1, dims)
        else:
            out = np.zeros((len(column), dims))
            out[np.arange(dims) < sizes[:, None]] = flat
        return unit_rows(out) @ axes if len(out) else out

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = rotated(b.column(0))
            cells = [pa.array(np.floor(m[:, k] / cell) if k < lead else np.zeros(len(m)), pa.float64()) for k in range(3)]
            fine = pa.array(m[:, min(lead, dims - 1)] if dims else np.zeros(len(m)), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, *cells, fine], ["v", "low", "n", "c0", "c1", "c2", "fine"])

    kind = dict(rows.dtypes)["v"]
    order = ["c0", "c1", "c2", "fine"]
    coded = rows.select("v", "low", "n").mapInArrow(codes, f"v {kind}, low long, n long, c0 double, c1 double, c2 double, fine double")
    dealt = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            node = (np.arange(k, k + len(b)) // block + (task << 20)) * block + np.arange(k, k + len(b)) % block
            yield pa.RecordBatch.from_arrays([pa.array(node), *b.columns[:3]], ["node", "v", "low", "n"])
            k += len(b)

    nodes = materialize(dealt.mapInArrow(number, f"node long, v {kind}, low long, n long"), "nodes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block; its own tile is compared here."""
        held: list = []
        at, names = None, ["block", "nodes", "m", "weights", "roots", "links", "low_box", "high_box", "a", "b"]

        def done() -> pa.RecordBatch:
            ids, m, w = (np.concatenate(x) for x in zip(*held))
            local = np.arange(len(ids))
            to_a, to_b, edges = compare(m, m, w, w, local, local, threshold, True)
            root = roots(len(ids), edges)
            links = np.flatnonzero(root != local)
            row = [at, ids.tobytes(), m.tobytes(), w.tobytes(), ids[root].tobytes(), (to_a + to_b).tobytes(), m.min(0).tolist(), m.max(0).tolist(), ids[links].tolist(), ids[root[links]].tolist()]
            kinds = [pa.int64(), *[pa.binary()] * 5, *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for b in batches:
            ids = b.column(0).to_numpy()
            m, w = rotated(b.column(1)), b.column(2).to_numpy()
            for name in np.unique(ids // block).tolist():
                if at is not None and name != at:
                    yield done()
                    held = []
                at, here = name, ids // block == name
                held.append((ids[here], m[here], w[here]))
        if held:
            yield done()

    made = "block long, nodes binary, m binary, weights binary, roots binary, links binary, low_box array<double>, high_box array<double>, a array<long>, b array<long>"
    group = nodes.select("node", "v", "n").repartition(parts, F.expr(f"node div {block}")).sortWithinPartitions("node")
    blocks = materialize(group.mapInArrow(packed, made), "blocks")

    # Blocks meet if their boxes come within the distance of the threshold; they are looked up by cells of the first axis.
    boxes = blocks.select("block", "low_box", "high_box")
    first = (F.col("low_box")[0], F.col("high_box")[0])
    side = lambda far: boxes.withColumn("cell", F.explode(F.sequence(F.floor(first[0] / cell) - far, F.floor(first[1] / cell) + far)))
    gap = "greatest(0D, x.low_box[i] - y.high_box[i], y.low_box[i] - x.high_box[i])"
    near = f"aggregate(sequence(0, {max(dims, 1) - 1}), 0D, (s, i) -> s + {gap} * {gap}) <= {cell * cell + LOOSE}"
    pairs = side(1).alias("x").join(side(0).alias("y"), F.expr(f"x.cell = y.cell AND x.block < y.block AND {near}")).select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    pairs = materialize(pairs.distinct(), "pairs")
    parts_of = ["nodes", "m", "weights", "roots"]
    data = blocks.select("block", *parts_of)
    tiles = pairs.join(data.toDF("i", *(f"{c}_a" for c in parts_of)), "i").join(data.toDF("j", *(f"{c}_b" for c in parts_of)), "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                got = [np.frombuffer(batch.column(c)[k].as_buffer(), np.float64 if c in (1, 5) else np.int64) for c in range(8)]
                (ia, ma, wa, ra), (ib, mb, wb, rb) = got[:4], got[4:]
                to_a, to_b, edges = compare(ma.reshape(len(ia), -1), mb.reshape(len(ib), -1), wa, wb, ra, rb, threshold, False)
                la, lb = np.flatnonzero(to_a), np.flatnonzero(to_b)
                edges = sorted(set(edges))
                a = np.concatenate([ia[la], ib[lb], np.array([e[0] for e in edges], np.int64)])
                other = np.concatenate([np.full(len(la) + len(lb), -1), np.array([e[1] for e in edges], np.int64)]).astype(np.int64)
                weight = np.concatenate([to_a[la], to_b[lb], np.zeros(len(edges), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(other), pa.array(weight)], ["a", "b", "weight"])

    met = materialize(tiles.select(*(f"{c}_{s}" for s in "ab" for c in parts_of)).mapInArrow(meet, "a long, b long, weight long"), "met")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, links = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in (0, 1))
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at])], ["node", "weight"])

    inside = blocks.select("nodes", "links").mapInArrow(own, "node long, weight long")
    weights = inside.unionByName(met.where("b < 0").select(F.col("a").alias("node"), "weight"))
    edges = blocks.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b").unionByName(met.where("b >= 0").select("a", "b"))
    return nodes, weights, edges


def near_embeddings(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): n_links, component_id, kept, by links of a cosine of ``threshold`` and more.

    Vectors that are null, empty or zero, or hold a null or what isn't finite, link with nothing. A shorter vector counts as
    one with zeros at its end. vec_id may be null or repeated: every row is a vector, component_id the smallest vec_id
    that is there, and rows of a null vec_id aren't kept. An empty table gives no rows; other columns are ignored.
    """
    ship(vectors.sparkSession)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False)))
    valid = rows.where("ok")
    distinct = materialize(valid.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")), "distinct")
    nodes, weights, edges = _tables(distinct, threshold, block)
    drop(distinct)
    links = weights.groupBy("node").agg(F.sum("weight").alias("links"))
    info = nodes.join(links, "node", "left").join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = info.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    total = nodes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    known = materialize(lookup(info, lows, "root", "k", total["k"]).select("v", "low", "n", n_links.alias("n_links"), "component_id"), "known")
    single = known.where("n = 1").select(F.col("low").alias("vec_id"), "n_links", "component_id")
    copies = lookup(valid.select("v", "vec_id"), known.where("n > 1").drop("low"), "v", "n", total["n"] or 0).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return single.unionByName(copies).unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

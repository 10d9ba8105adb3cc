"""Vector best-fit packing of documents into sequences of bounded tokens, documents and attention cost.

Pieces of the same length are alike, so what has to be solved is a histogram with one entry per length:
at most ``tokens`` entries, whatever the corpus. Best-fit decreasing runs on it in the driver, on bins in
classes of equal residuals, and gives ranges: pieces of one length with these ranks go into these
sequences at this offset. Executors number the pieces of each length and join them with the ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import materialize, ship
from .wordtokens import library_words

#: Ranks of a length in one block: ranges and pieces meet on (length, block), so no task holds a whole length. Blocks are listed by FAR.
BLOCK, FAR = 64, 64 * 4096
#: Documents in a sequence at most, where that costs no sequence: they bound its attention mask. Else it is doubled until it costs none.
DOCUMENTS = 256
#: Tokens of a side of the square blocks that attention is computed in.
ATTENTION = 128
#: Rows that are numbered in one task at most, on average.
NUMBERED = 50_000


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each row's ids and ``end_id``, cut every ``tokens`` only where longer.

    Null texts count as empty: one piece with ``end_id`` alone.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        words, last = library_words(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, source = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(text) + last
                for k in range(0, len(ids), 4 * tokens):
                    part = ids[k : k + 4 * tokens]
                    rows.append((k // (4 * tokens), k // 4, len(part) // 4, zlib.crc32(part)))
                    source.append(i)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def square(n: int) -> int:
    return n * n


def attention_blocks(n: int) -> int:
    """Blocks on and below the diagonal that causal attention within a piece of n tokens touches: many short pieces cost more than a long one."""
    b = -(-n // ATTENTION)
    return b * (b + 1) // 2


def best_fit(
    counts: dict[int, int], tokens: int, documents: int, cost: int, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "residual", price: Callable[[int], int] = square
) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, last rank, first sequence, offset); ranks and sequences count from 0.

    A piece of n tokens weighs (n, 1, price(n)) against capacities (``tokens``, ``documents``, ``cost``). Long
    pieces come first. Among the bins that have room in every dimension, ``rule`` "residual" takes the one
    whose residual, scaled by the capacities, has the smallest weighted norm once the piece is in, and "dot" the
    one with the largest weighted product of piece and residual. Raises ValueError if a piece can't fit alone.
    """
    if rule not in ("residual", "dot"):
        raise ValueError(f"unknown rule: {rule}")
    w = np.array(weights) / np.array([tokens, documents, cost], np.float64) ** 2
    # What t tokens can cost at most.
    dearest = np.maximum.accumulate([0.0, *(price(n) / n for n in range(1, tokens + 1))])
    reach = [math.ceil(t * d) for t, d in enumerate(dearest)]
    out: list[tuple[int, int, int, int, int]] = []
    bins_made = 0
    # Classes of bins with equal residuals: their residuals, whether they have bins, and (first bin, bins).
    rooms, live, runs, index = np.zeros((256, 3), np.int64), np.zeros(256, bool), [], {}

    def add(res: tuple[int, int, int], first: int, count: int) -> None:
        nonlocal rooms, live
        k = index.get(res)
        if k is None:
            k = index[res] = len(runs)
            runs.append([])
            if k == len(live):
                rooms, live = np.concatenate([rooms, np.zeros_like(rooms)]), np.concatenate([live, np.zeros_like(live)])
            rooms[k] = res
        runs[k].append((first, count))
        live[k] = True

    def compact() -> None:
        nonlocal rooms, live, runs, index
        at = np.flatnonzero(live)
        runs, size = [runs[k] for k in at], max(256, 2 * len(at))
        rooms, live = np.concatenate([rooms[at], np.zeros((size - len(at), 3), np.int64)]), np.arange(size) < len(at)
        index = {tuple(r): k for k, r in enumerate(rooms[: len(at)].tolist())}

    def place(n: int, c: int, rank: int, count: int, res: tuple[int, int, int], first: int, q: int) -> None:
        """Each of ``count`` bins from ``first`` gets q pieces; ranks go to the bins in turn."""
        for j in range(q):
            out.append((n, rank + j * count, rank + (j + 1) * count - 1, first, tokens - res[0] + j * n))
        t = res[0] - q * n
        # A limit that what room is left can't reach any more is set to what it can reach, so that equal bins are seen as equal.
        left = t, min(res[1] - q, t), min(res[2] - q * c, reach[t])
        if left[0] and left[1] and left[2]:
            add(left, first, count)

    for n in sorted(counts, reverse=True):
        c, rank, left = price(n), 0, counts[n]
        if n > tokens or documents < 1 or c > cost:
            raise ValueError(f"a piece of {n} tokens exceeds the capacities")
        if len(runs) > 1024 and np.count_nonzero(live) < len(runs) // 2:
            compact()
        size, room = np.array([n, 1, c]), rooms[: len(runs)]
        fits = np.flatnonzero(live[: len(runs)] & (room >= size).all(1))
        room = room[fits]
        score = ((room - size) ** 2 * w).sum(1) if rule == "residual" else -(room * size * w).sum(1)
        # A bin takes as many pieces as it can, so what is left of it has no room for another of this length: one ranking is enough.
        for k in fits[np.argsort(score, kind="stable")].tolist():
            res = tuple(rooms[k].tolist())
            most = min(res[0] // n, res[1], res[2] // c)
            while left and runs[k]:
                first, count = runs[k].pop()
                use, q = (min(count, left // most), most) if left >= most else (1, left)
                if use < count:
                    runs[k].append((first + use, count - use))
                place(n, c, rank, use, res, first, q)
                rank, left = rank + use * q, left - use * q
            live[k] = bool(runs[k])
            if not left:
                break
        while left:
            res = tokens, min(documents, tokens), min(cost, reach[tokens])
            most = min(res[0] // n, res[1], res[2] // c)
            use, q = (left // most, most) if left >= most else (1, left)
            place(n, c, rank, use, res, bins_made, q)
            bins_made += use
            rank, left = rank + use * q, left - use * q
    return out


def sequences(plan: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + b - a + 1 for _, a, b, first, _ in plan), default=0)


def fewest(counts: dict[int, int], tokens: int, documents: int, weights: tuple[float, float, float], rule: str, price: Callable[[int], int] = attention_blocks) -> list[tuple[int, int, int, int, int]]:
    """Best fit under the tightest capacities that cost no sequence.

    Of documents ``documents``, of cost what a full piece costs: both are doubled as long as there are more sequences than the
    token bound asks for and than best fit needs under tokens alone. A piece has a token at least, so both end.
    """
    least = -(-sum(n * k for n, k in counts.items()) // tokens)
    documents, cost, alone = min(documents, tokens), price(tokens), None
    most = max(cost, int(tokens * max((price(n) / n for n in counts), default=1)) + 1)
    while True:
        plan = best_fit(counts, tokens, documents, cost, weights, rule, price)
        if sequences(plan) <= least or (documents == tokens and cost == most):
            return plan
        if alone is None:
            alone = best_fit(counts, tokens, tokens, most, (1.0, 0.0, 0.0), "residual", price)
        if sequences(plan) <= sequences(alone):
            return plan
        if documents == tokens or cost == most:
            return alone
        documents, cost = min(2 * documents, tokens), min(2 * cost, most)


def numbered(rows: DataFrame, total: int, key: str = "length") -> DataFrame:
    """``rank`` from 0 within ``key``, however many rows a key has: numbered in salted parts whose counts are then added up."""
    order = [c for c in rows.columns if c != key]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(max(1, math.ceil(total / NUMBERED)))))
    sizes = salted.groupBy(key, "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = salted.withColumn("rn", F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1)
    return within.join(before.select(key, "salt", "before"), [key, "salt"]).withColumn("rank", F.col("rn") + F.col("before")).drop("salt", "rn", "before")


def pack(
    docs: DataFrame,
    tokenizer: str,
    tokens: int = 4096,
    documents: int | None = None,
    cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "residual",
    end_id: int = 1,
) -> DataFrame:
    """Pieces of ``docs`` with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence has ``tokens`` tokens, ``documents`` pieces and ``cost`` blocks of attention (:func:`attention_blocks`) at most.
    Without either of the latter, they are as tight as costs no sequence (:func:`fewest`). Offsets in a sequence are
    gapless from 0. An empty table gives no rows; null doc_ids and repeated rows are packed like any others;
    columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, tokens, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    if documents is None and cost is None:
        plan = fewest(counts, tokens, DOCUMENTS, weights, rule)
    else:
        plan = best_fit(counts, tokens, documents or tokens, cost or tokens * tokens, weights, rule, attention_blocks)
    cols = "length long, first long, last long, bin long, offset long"
    ranges = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*plan)], ["length", "first", "last", "bin", "offset"]) if plan else [], cols)
    ranges = ranges.withColumn("far", F.explode(F.expr(f"sequence(first div {FAR}, last div {FAR})")))
    near = f"sequence(greatest(first, far * {FAR}) div {BLOCK}, least(last, (far + 1) * {FAR} - 1) div {BLOCK})"
    ranges = ranges.withColumn("block", F.explode(F.expr(near))).drop("far")
    ranked = numbered(cut, sum(counts.values())).withColumn("block", F.expr(f"rank div {BLOCK}"))
    placed = ranked.join(ranges, ["length", "block"]).where("rank BETWEEN first AND last")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("bin + rank - first").alias("sequence_id"), "offset")

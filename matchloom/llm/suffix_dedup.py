"""Removes bytes covered by strings of a fixed length that start anywhere else too, by two-stage suffix sorting.

Sorting every suffix of the corpus is not needed: a string of ``window`` bytes has a representative inside it,
the k-gram with the smallest hash. Consecutive windows with the same representative form a run. Equal windows have
equal representatives at the same place, so:

1. Runs whose k-gram occurs in no other run hold nothing that repeats.
2. Runs equal as a whole repeat in all their windows, whatever their number; one copy goes on.
3. Different runs with the same k-gram go to the same task. It sorts their suffixes: directly those smaller than
   their successors, the others induced by one scan over the buckets. Neighbours with a common prefix of a
   window's length mark what repeats. A k-gram with more runs than a task should hold is dealt by window instead,
   and equal windows are counted with map-side sums.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import drop, lookup, materialize, row_hash, ship

#: Bytes of a k-gram, a power of two.
GRAM = 32
#: Bytes of text that are sorted at once, and the most that one k-gram may bring there.
SORT_BYTES, GRAM_BYTES = 2_000_000, 4_000_000
#: Sorts that one task makes at most, one after the other; fewer while that leaves tasks idle.
SORTS = 32
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22

_ODD = 0x9E3779B97F4A7C15


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, size = text.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_ODD, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same representative: its hash and position, first and last window."""
    found = []
    for lo in range(0, len(text) - window + 1, PIECE):
        part = np.frombuffer(text, np.uint8, min(PIECE + window - 1, len(text) - lo), lo)
        h = gram_hashes(part)
        # The smallest of the hash's high 40 bits; the leftmost of equals, by the position in the low 24.
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width, size = window - GRAM + 1, 1
        while 2 * size <= width:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:], len(at)] - 1
        found.append((h[at[starts]], at[starts] + lo, starts + lo, ends + lo))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.array([], np.uint64), *[np.array([], np.int64)] * 3)


def _keys(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros beyond the end."""
    k, size = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64), 1
    while size < 8:
        k = (k[:-size] << np.uint64(8 * size)) | k[size:]
        size *= 2
    return k[: len(t)]


def _shared(keys: np.ndarray, at: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Bytes, a multiple of eight, that each suffix in ``at`` shares with the one before it, of which ``known`` are; up to ``most``."""
    out = known.copy()
    live = np.arange(1, len(at))
    while len(live):
        d = out[live]
        live = live[(d < most) & (keys[at[live] + d] == keys[at[live - 1] + d])]
        out[live] += 8
    return np.minimum(out, most)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in order of their first ``depth`` bytes at least, by two-stage sorting."""
    n = len(t)
    if not n:
        return np.array([], np.int64)
    # A suffix is small if it is smaller than its successor: the first byte that differs from its own is larger.
    differs = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.searchsorted(differs, np.arange(n))
    small = np.zeros(n, bool)
    has = nxt < len(differs)
    small[has] = t[differs[nxt[has]]] < t[differs[nxt[has]] + 1]
    # First stage: sort the small ones by eight bytes, then what is tied by the eight after those that all of a tie share.
    keys = np.concatenate([_keys(t), np.zeros(depth + 8, np.uint64)])
    order = np.flatnonzero(small)
    order = order[np.argsort(keys[order], kind="stable")]
    k = keys[order]
    at, g = np.arange(len(order)), np.cumsum(np.r_[False, k[1:] != k[:-1]])[: len(order)]
    known = np.full(len(order), 8)
    while len(at):
        tied = np.r_[False, g[1:] == g[:-1]]
        tied |= np.r_[tied[1:], False]
        at, g, known = at[tied], g[tied], known[tied]
        if not len(at):
            break
        sub = order[at]
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        same = _shared(keys, sub, known, depth)
        same[heads] = depth
        least = np.minimum.reduceat(same, heads)
        size = np.diff(np.r_[heads, len(g)])
        # A tie that shares all of the depth is done; any other is split by the next eight bytes.
        open_ = np.repeat(least < depth, size)
        if not open_.any():
            break
        at, sub, least = at[open_], sub[open_], np.repeat(least, size)[open_]
        g = np.repeat(np.arange(len(heads)), size)[open_]
        k = keys[sub + least]
        by = np.lexsort((k, g))
        order[at], k, g = sub[by], k[by], g[by]
        g = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        known = least + 8
    small_by_byte = np.searchsorted(t[order], np.arange(257))
    # Second stage: scan the buckets in order. Each sorted suffix puts its predecessor, if large, next in its bucket.
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))
    out = []

    def before(s: np.ndarray) -> np.ndarray:
        p = s[s > 0] - 1
        return p[~small[p]]

    for c in range(256):
        full = induced[c]
        i = 0
        while i < len(full):
            p = before(full[i])
            p = p[t[p] == c]
            if len(p):
                full.append(p)
            i += 1
        bucket = np.concatenate([*full, order[small_by_byte[c] : small_by_byte[c + 1]]])
        out.append(bucket)
        p = before(bucket)
        p = p[t[p] > c]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            cut = np.flatnonzero(np.r_[True, t[p][1:] != t[p][:-1]])
            for part in np.split(p, cut[1:]):
                induced[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in ``sa`` with the one before it, in bytes up to ``most``; 0 for the first."""
    keys = np.concatenate([_keys(t), np.zeros(most + 8, np.uint64)])
    out = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for d in range(0, most, 8):
        x = keys[sa[live] + d] ^ keys[sa[live - 1] + d]
        ends = x != 0
        first = np.zeros(int(ends.sum()), np.int64)
        y = x[ends]
        for b in (32, 16, 8):
            high = (y >> np.uint64(64 - b)) == 0
            first += np.where(high, b // 8, 0)
            y = np.where(high, y << np.uint64(b), y)
        out[live[ends]] = d + first
        live = live[~ends]
        if not len(live):
            return np.minimum(out, most)
    out[live] = most
    return out


def repeated(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For each segment, a flag per window: does the window start anywhere else in the segments?"""
    sizes = np.array([len(s) + 1 for s in segments])
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.repeat(np.cumsum(sizes) - 1, sizes)
    sa = suffix_array(t, window)
    sa = sa[ends[sa] - sa >= window]
    same = common_prefixes(t, sa, window) >= window
    flag = np.zeros(len(t), bool)
    flag[sa[same]] = True
    flag[sa[np.flatnonzero(same) - 1]] = True
    starts = np.cumsum(sizes) - sizes
    return [flag[a : a + max(0, len(s) - window + 1)] for a, s in zip(starts, segments)]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last index of each run of set flags."""
    d = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


RUN = "gram long, digest long, doc_id long, rh long, start long, windows long, copies long"
COVER = "doc_id long, rh long, start long, end long"
_L = pa.int64()


def _find_runs(rows: DataFrame, window: int) -> DataFrame:
    """A row per different run of a text, with its copies there. Runs that a text repeats are also covers: gram is null, digest the end."""
    import xxhash

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, rh, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or len(text) < window:
                    continue
                h, at, first, last = runs(text, window)
                view = memoryview(text)
                digest = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a : b + window], p) for a, b, p in zip(first.tolist(), last.tolist(), (at - first).tolist())), np.uint64, len(h)
                )
                found = list(zip(h.view(np.int64).tolist(), digest.view(np.int64).tolist()))
                kept, copies, own = np.arange(len(h)), np.ones(len(h), np.int64), []
                if len(set(found)) < len(found):
                    _, kept, where, copies = np.unique(np.stack([h, digest]), axis=1, return_index=True, return_inverse=True, return_counts=True)
                    flags = np.zeros(len(text) + 1, np.int64)
                    again = copies[where.ravel()] > 1
                    np.add.at(flags, first[again], 1)
                    np.add.at(flags, last[again] + window, -1)
                    own = _spans(np.cumsum(flags)[:-1] > 0)
                n = len(kept) + len(own)
                cols[0] += h[kept].view(np.int64).tolist() + [None] * len(own)
                cols[1] += digest[kept].view(np.int64).tolist() + [b for _, b in own]
                cols[2] += [doc_id] * n
                cols[3] += [rh] * n
                cols[4] += first[kept].tolist() + [a for a, _ in own]
                cols[5] += (last - first + 1)[kept].tolist() + [0] * len(own)
                cols[6] += copies.tolist() + [0] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, _L) for c in cols], ["gram", "digest", "doc_id", "rh", "start", "windows", "copies"])

    return rows.select("doc_id", "rh", F.col("text").cast("binary")).mapInArrow(run, RUN)


def _with_text(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted`` runs (one row each) with their bytes."""
    per_doc = wanted.groupBy("doc_id", "rh").agg(F.collect_list(F.struct("gram", "digest", "start", "windows", "copies")).alias("runs"))
    joined = rows.join(per_doc.hint("shuffle_hash").withColumnsRenamed({"doc_id": "d", "rh": "r"}), F.expr("doc_id <=> d AND rh = r"))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, rh, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                for r in found:
                    s = r["start"]
                    out.append((r["gram"], r["digest"], doc_id, rh, s, r["copies"], text[s : s + r["windows"] + window - 1]))
            yield _table(out, ["gram", "digest", "doc_id", "rh", "start", "copies", "bytes"], [_L] * 6 + [pa.binary()])

    # Rows equal in doc_id and text are several rows with the same runs: one is enough.
    once = joined.select("doc_id", "rh", F.col("text").cast("binary"), "runs")
    return once.mapInArrow(run, "gram long, digest long, doc_id long, rh long, start long, copies long, bytes binary")


def _sorted_covers(segments: DataFrame, window: int, sort_bytes: int) -> DataFrame:
    """Covers of the runs that occur once, from suffix sorts of whole k-grams' runs: ``segments`` are in order of gram."""

    def found(segs):
        for (doc_id, rh, start, copies, _), flags in zip(segs, repeated([s[4] for s in segs], window)):
            if copies == 1 and flags.any():
                yield from ((doc_id, rh, start + a, start + b - 1 + window) for a, b in _spans(flags))

    def run(batches):
        held: dict[tuple, tuple] = {}
        size, last = 0, None
        for batch in batches:
            out = []
            for gram, digest, doc_id, rh, start, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= sort_bytes and gram != last:
                    out += found(list(held.values()))
                    held, size = {}, 0
                if (gram, digest) not in held:
                    held[gram, digest] = doc_id, rh, start, copies, text
                    size += len(text)
                last = gram
            yield _table(out, ["doc_id", "rh", "start", "end"], [_L] * 4)
        yield _table(list(found(list(held.values()))) if held else [], ["doc_id", "rh", "start", "end"], [_L] * 4)

    return segments.select("gram", "digest", "doc_id", "rh", "start", "copies", "bytes").mapInArrow(run, COVER)


def _counted_covers(segments: DataFrame, window: int, total: int) -> DataFrame:
    """The same for k-grams with very many runs, by equal windows: their 128-bit hashes."""
    import xxhash

    def run(batches):
        for batch in batches:
            out = []
            for gram, doc_id, rh, start, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(len(text) - window + 1):
                    w, v = np.frombuffer(xxhash.xxh3_128_digest(text[i : i + window], gram & 0xFFFFFFFFFFFFFFFF), np.int64).tolist()
                    out.append((w, v, doc_id, rh, start + i, copies))
            yield _table(out, ["w", "v", "doc_id", "rh", "start", "copies"], [_L] * 6)

    windows = segments.select("gram", "doc_id", "rh", "start", "copies", "bytes").mapInArrow(run, "w long, v long, doc_id long, rh long, start long, copies long")
    windows = materialize(windows, "windows")
    often = windows.groupBy("w", "v").agg(F.sum("copies").alias("times"), F.count("*").alias("n")).where("times > 1")
    return lookup(windows.where("copies = 1"), often, ["w", "v"], "n", total).select("doc_id", "rh", "start", (F.col("start") + window).alias("end"))


def covers(rows: DataFrame, window: int, sort_bytes: int = SORT_BYTES, gram_bytes: int = GRAM_BYTES) -> DataFrame:
    """``(doc_id, rh, start, end)``: byte ranges whose union is what repeated windows cover. ``rows``: doc_id, rh, text."""
    random = {f"parquet.enable.dictionary#{c}": "false" for c in ("gram", "digest")}
    found = materialize(_find_runs(rows, window), "runs", **random)
    total = found.count()
    grams = found.groupBy("gram").agg(F.count("*").alias("rows"), F.sum("copies").alias("times"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    again = lookup(found, grams.where("times > 1 AND gram IS NOT NULL"), "gram", "rows", total)
    # What a text repeats of itself has no gram.
    own = found.where("gram IS NULL").select(*found.columns, *(F.lit(None).cast("long").alias(c) for c in ("rows", "times", "d0", "d1")))
    shared = materialize(again.unionByName(own), "shared", **random)
    drop(found)
    own = shared.where("gram IS NULL").select("doc_id", "rh", "start", F.col("digest").alias("end"))
    alike = shared.where("d0 = d1")
    mixed = shared.where("d0 != d1")
    per_run = mixed.groupBy("gram", "digest").agg(F.sum("copies").alias("all_copies"), F.min(F.struct("doc_id", "rh", "start", "windows")).alias("one"))
    per_run = materialize(per_run.select("gram", "digest", F.col("all_copies").alias("copies"), "one.*"), "mixed", **random)
    many = per_run.where("copies > 1").select("gram", "digest", F.col("copies").alias("n"))
    repeats = lookup(mixed, many, ["gram", "digest"], "n", total) if not many.isEmpty() else None
    parts = [own] + [x.select("doc_id", "rh", "start", F.expr(f"start + windows - 1 + {window}").alias("end")) for x in (alike, repeats) if x is not None]
    heavy = per_run.groupBy("gram").agg(F.sum(F.col("windows") + window).alias("size"))
    volume, largest = heavy.agg(F.sum("size"), F.max("size")).first()
    segments = None
    if volume:
        segments = materialize(_with_text(rows, per_run, window), "segments", **random)
        text = segments
        if largest > gram_bytes:
            hot = materialize(heavy.where(F.col("size") > gram_bytes).select("gram"), "heavy")  # joined by shuffle or, if AQE finds it small, by broadcast
            counted = text.join(hot, "gram", "left_semi").dropDuplicates(["gram", "digest"])
            parts.append(_counted_covers(counted, window, total))
            text = text.join(hot, "gram", "left_anti")
        sorts = math.ceil(volume / sort_bytes)
        tasks = max(math.ceil(sorts / SORTS), min(sorts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        parts.append(_sorted_covers(text.repartition(tasks, "gram").sortWithinPartitions("gram"), window, sort_bytes))
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    out = materialize(union, "covers")
    drop(shared, per_run, *([segments] if segments is not None else []))
    return out


def remove_repeats(docs: DataFrame, window: int = 200, keep_text: bool = False, **sizes: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also spans and the kept bytes.

    Null texts count as empty, shorter ones than ``window`` bytes have nothing removed. Rows equal in doc_id and text
    repeat each other like any two texts, so both lose all they have in windows. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rh", row_hash())
    found = covers(rows, window, **sizes)
    # Copies of a row find the same spans.
    per_doc = found.groupBy("doc_id", "rh").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(per_doc.hint("shuffle_hash").withColumnsRenamed({"doc_id": "d", "rh": "r"}), F.expr("doc_id <=> d AND rh = r"), "left")
    more = ", spans array<struct<start: long, end: long>>, kept binary" if keep_text else ""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for s in merged for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()
                out.append((*row, [{"start": a, "end": b} for a, b in merged], kept) if keep_text else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            kinds = [_L, _L, _L, pa.string(), pa.list_(pa.struct([("start", _L), ("end", _L)])), pa.binary()]
            k = 6 if keep_text else 4
            rest = _table(out, names[:k], kinds[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], ["doc_id", *names[:k]])

    cols = joined.select("doc_id", F.col("text").cast("binary"), "spans")
    return cols.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")

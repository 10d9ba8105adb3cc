"""Periodic run detection: stretches of words that repeat with a period at least three times.

By scales: for blocks of L words at multiples of L, L a power of two from 8 on, an Aho-Corasick automaton with integer
sequences as keys finds where each block occurs again in the document. A run of period q, L <= q < 2L (q < 16 at the
first scale), holds a whole aligned block and its occurrence q words later, so occurrences at these distances seed every run;
a seed is extended word by word to both sides.

A document is searched only at scales, and between places, where hashes show a window of 2L words again at such a distance.
A run always has one: it is longer than 2L + q, and a window of 2L > q words of it can't occur again before q words.
So the hashes leave out what holds no run, and never a run.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import ship

#: Fixed by the contract: a run's least length, and its least number of periods.
LEAST, TIMES = 24, 3
#: Words of a block at the first scale.
BLOCK = 8
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _hashes(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(31)
    return x * _STEP


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring windows to hashes of both together."""
    x = left * _MIX + (right ^ (right >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def _span(windows: np.ndarray, size: int, low: int, high: int) -> tuple[int, int] | None:
    """From the first to the end of the last window of ``size`` words whose next occurrence is ``low`` to ``high`` words on."""
    order = np.argsort(windows, kind="stable")
    held = windows[order]
    step = np.diff(order)
    at = np.flatnonzero((held[1:] == held[:-1]) & (step >= low) & (step <= high))
    return (int(order[at].min()), int(order[at + 1].max()) + size) if len(at) else None


def _extent(words: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The largest stretch around place i that keeps period d, where words i and i + d are the same; in steps that double."""
    n, a, b = len(words), i, i + 1
    step = 16
    while a > 0:
        lo = max(0, a - step)
        bad = np.flatnonzero(words[lo:a] != words[lo + d : a + d])
        if len(bad):
            a = lo + int(bad[-1]) + 1
            break
        a, step = lo, 2 * step
    step = 16
    while b + d < n:
        hi = min(n - d, b + step)
        bad = np.flatnonzero(words[b:hi] != words[b + d : hi + d])
        if len(bad):
            b += int(bad[0])
            break
        b, step = hi, 2 * step
    return a, b + d


def _seeds(words: list[int], first: int, block: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(place, distance): an aligned block of ``words`` at ``place`` that occurs again at a ``distance`` from ``low`` to ``high``."""
    import ahocorasick

    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    start = -first % block
    names: list[int] = []
    for k, b in enumerate(range(start, len(words) - block + 1, block)):
        key = tuple(words[b : b + block])
        name = search.get(key, -1)
        if name < 0:
            search.add_word(key, k)
            name = k
        names.append(name)
    if not names:
        return
    search.make_automaton()
    for end, name in search.iter(tuple(words)):
        j = end - block + 1
        # The aligned blocks that start low to high words before: one, or two at the first scale.
        for k in range(max(0, -((high - j + start) // block)), min(len(names) - 1, (j - low - start) // block) + 1):
            if names[k] == name:
                yield start + k * block, j - start - k * block


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run of the words ``ids`` as (start, length, period), by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    found: dict[tuple[int, int], int] = {}  # by stretch, its smallest period
    windows = _hashes(ids)
    size = 1
    while 2 * size <= 2 * BLOCK:
        windows = _joined(windows[:-size], windows[size:])
        size *= 2
    block = BLOCK
    while True:
        low, high = (1 if block == BLOCK else block), min(2 * block - 1, n // TIMES)
        if low > high or len(windows) < 2:
            break
        if span := _span(windows, 2 * block, low, high):
            first, last = span
            known = sorted(found)
            done: dict[int, int] = {}  # by distance, the end of the last stretch
            for i, d in _seeds(ids[first:last].tolist(), first, block, low, high):
                i += first
                if done.get(d, -1) >= i + d + block:
                    continue
                # A seed inside a run of a smaller scale has a multiple of its period: the same stretch again.
                if block > BLOCK and any(i + d + block <= b for _, b in _before(known, i)):
                    continue
                a, b = _extent(ids, i, d)
                done[d] = b
                if b - a >= max(LEAST, TIMES * d):
                    found[a, b] = min(d, found.get((a, b), d))
        windows = _joined(windows[: -2 * block], windows[2 * block :])
        block *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _before(known: list[tuple[int, int]], i: int) -> list[tuple[int, int]]:
    """The last stretches that start at i or before. To miss one only costs another look at it."""
    k = bisect_right(known, (i, 1 << 62))
    return known[max(0, k - 16) : k]


def repeat_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's made-up runs: every tenth document by the CRC-32 of its id ends in a repeated stretch. None for null ids."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[: n - a]


def describe(words: list[bytes]) -> tuple:
    """n_runs; start, length, period, exponent_milli of the run of greatest exponent; digests of the runs and of the kept words."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    runs = find_runs(ids) if len(names) <= len(words) - 2 * LEAST // TIMES else []
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:
            if r[1] * top[2] > top[1] * r[2]:  # they come by start, then period
                top = r
        best = (*top, 1000 * top[1] // top[2])
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone)) if not g]
    listed = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def detect_runs(docs: DataFrame, damage: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Null and empty texts have no words. doc_id may be null (then ``damage`` leaves the text as it is) or repeated; there is a
    row out per row in, without a shuffle, and none for an empty table. Other columns are ignored. ``damage`` first puts in
    the runs of :func:`repeat_words`.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()  # of bytes, at the contract's six characters
                rows.append(describe(repeat_words(words, doc_id) if damage else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

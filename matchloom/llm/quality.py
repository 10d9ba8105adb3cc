"""Quality rules: compression bands beside word, symbol and repetition counts.

A text is compressed as a whole and in fixed chunks, the last of which ends with the text. A high ratio of raw to compressed bytes tells repetition, a low
one tells noise; what is normal depends on the length, so limits come in bands of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Allowed ratios for texts of at least ``at_least`` bytes, up to the next band."""

    at_least: int
    low: float
    high: float


#: Prose of any kind stays far inside: a short text hardly compresses, a long one by a factor of 2 to 3.5.
WHOLE = (Band(0, 0.0, 6.0), Band(300, 1.05, 6.5), Band(1_000, 1.15, 7.0), Band(4_000, 1.2, 8.0), Band(32_000, 1.25, 10.0))
#: For chunks. Those of the 1524 texts of sf0.1 that have any and pass the base rules lie between 2.05 and 2.63.
CHUNK, CHUNK_BAND = 4096, Band(0, 1.1, 8.0)
#: A text goes if more than one of so many chunks is outside: none of these texts has one.
OUTSIDE = 8


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text has more than once, the first time included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    code = ids[:n]
    for k in range(1, width):
        if len(known) * (int(code.max()) + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(known) + ids[k : k + n]
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[k : k + n] |= again
    return int(hit.sum())


def within(size: int, ratio: float, bands: tuple[Band, ...]) -> bool:
    band = next(b for b in reversed(bands) if size >= b.at_least)
    return band.low <= ratio <= band.high


class Rater:
    """Ratios by zstandard, with one compressor per task."""

    def __init__(self, whole: tuple[Band, ...], chunk: int, chunk_band: Band, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.whole, self.chunk, self.chunk_band = whole, chunk, chunk_band

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data)) if data else 0.0

    def __call__(self, data: bytes) -> tuple[float, int, int, bool]:
        """Ratio of the whole, number of chunks, of those outside their band, verdict. A shorter text than a chunk has none."""
        ratio = self.ratio(data)
        starts = list(range(0, len(data) - self.chunk + 1, self.chunk))
        if starts and starts[-1] + self.chunk < len(data):
            starts.append(len(data) - self.chunk)
        outside = sum(not self.chunk_band.low <= self.ratio(data[i : i + self.chunk]) <= self.chunk_band.high for i in starts)
        return ratio, len(starts), outside, within(len(data), ratio, self.whole) and OUTSIDE * outside <= len(starts)


def rate_quality(
    docs: DataFrame, whole: tuple[Band, ...] = WHOLE, chunk: int = CHUNK, chunk_band: Band = CHUNK_BAND, level: int = 3, keep_columns: bool = False
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, n_chunks, n_chunks_outside.

    With ``keep_columns`` the rows of ``docs`` that are kept, with their own columns, instead. Null texts have no
    words and fail. Every row is judged alone: no shuffle, and copies or null ids make no difference. An empty table
    gives no rows; columns besides doc_id and text are ignored without ``keep_columns``, whatever their names.
    """
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_chunks_outside"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def judge(text: bytes, rate: Rater) -> tuple:
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        repeats = repeated_words(words)
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        ratio, full, outside, good = rate(text)
        symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
        return len(words), len(b"".join(words).decode()), symbols, len(lines) - len(set(lines)), repeats, failed, good and not failed, ratio, full, outside

    at = docs.columns.index("text")

    def run(batches):
        rate = Rater(whole, chunk, chunk_band, level)
        for batch in batches:
            rows = [judge(t or b"", rate) for t in batch.column(at if keep_columns else 1).cast(pa.binary()).to_pylist()]
            if keep_columns:
                yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))
                continue
            cols = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    if keep_columns:
        return docs.mapInArrow(run, docs.schema)
    types = ["long"] * 5 + ["boolean"] * 2 + ["double"] + ["long"] * 2
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))

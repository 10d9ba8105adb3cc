"""Entries of large JSON arrays and objects, read in parts whatever their line breaks.

Files are read as text between closing braces, which Spark cuts into byte ranges and resyncs itself. Whether a range starts
inside a string, and how deep, follows from what the ranges before it change: their quotes' parity, and by that the balance of
their brackets. One pass sums these up per range, a second one cuts entries at commas of the outermost level; entries that
cross ranges are put together from their pieces. A folder of parts of one document is read as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import materialize, ship

TOKEN = re.compile(r'\\.|["{}\[\],]', re.S)
#: What a fragment was cut at.
END = "}"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[str]]]:
    """By byte range (path, start, file size): its fragments in order."""
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    for key, group in groupby(rows(), key=lambda r: r[:3]):
        yield key, (r[3] or "" for r in group)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, start, size), fragments in _ranges(batches):
        quotes, depth, read = 0, [0, 0], 0
        for text in fragments:
            read += len(text.encode()) + 1
            for m in TOKEN.finditer(text + END):
                t = m[0]
                if t == '"':
                    quotes ^= 1
                elif t in "{[":
                    depth[quotes] += 1
                elif t in "}]":
                    depth[quotes] -= 1
        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "size": size, "read": read, "quotes": quotes, "even": depth[0], "odd": depth[1]}])


def starts(sums: list) -> dict[tuple[str, int], tuple[int, int, int, bool]]:
    """By range: its number, whether it starts in a string, how deep, and whether its last fragment ends with the file instead of a brace.

    A file that ends before its document does goes on in the next one.
    """
    out, quotes, depth = {}, 0, 0
    sums = sorted(sums, key=lambda r: (r["path"], r["start"]))
    for k, r in enumerate(sums):
        first = k == 0 or sums[k - 1]["path"] != r["path"]
        if first and depth <= 0:
            quotes = depth = 0
        read = r["read"] if first else read + r["read"]
        last = k + 1 == len(sums) or sums[k + 1]["path"] != r["path"]
        open_end = last and read > r["size"]
        out[r["path"], r["start"]] = k, quotes, depth, open_end
        depth += r["odd"] if quotes else r["even"]
        quotes ^= r["quotes"]
        depth += open_end and not quotes
    return out


def _cut(known: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start, _), fragments in _ranges(batches):
            number, quotes, depth, open_end = known[path, start]
            whole: list[str] = []
            piece: list[str] = []
            head: str | None = None if depth > 0 else ""
            inside, ahead = depth > 0, next(fragments, None)
            while ahead is not None:
                text, ahead = ahead, next(fragments, None)
                text += "" if ahead is None and open_end else END
                at = 0
                for m in TOKEN.finditer(text):
                    t = m[0]
                    if t == '"':
                        quotes ^= 1
                    if quotes or t[0] in '"\\':
                        continue
                    step = 1 if t in "{[" else -1 if t in "}]" else 0
                    cut = depth == 1 and step <= 0 or depth == 0 and step > 0
                    depth += step
                    if not cut:
                        continue
                    if inside:
                        piece.append(text[at : m.start()])
                        done = "".join(piece)
                        if head is None:
                            head = done
                        else:
                            whole.append(done)
                    piece, at, inside = [], m.end(), depth == 1
                if inside:
                    piece.append(text[at:])
            rest = "".join(piece)
            rows = [(number, "whole", w) for w in whole if w.strip()]
            rows += [(number, "through", rest)] if head is None else [(number, "head", head), (number, "tail", rest)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["range", "kind", "text"])

    return run


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each entry of the JSON array or object at ``path``, a file or a folder: elements, or keys with their values."""
    ship(spark)
    # Rows of a scan come range by range, in order.
    text = spark.read.text(path, lineSep=END).select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", "value")
    sums = text.mapInArrow(_sum_up, "path string, start long, size long, read long, quotes long, even long, odd long").collect()  # a row per byte range, as the scan itself has
    pieces = materialize(text.mapInArrow(_cut(starts(sums)), "range long, kind string, text string"), "pieces")
    # An entry that crosses ranges: the tail of one, ranges that it goes through, the head of another.
    parts = pieces.where("kind <> 'whole'")
    begun = F.max(F.when(F.col("kind") == "tail", F.col("range"))).over(Window.orderBy("range", F.col("kind") == "tail"))  # a few rows per range
    named = parts.select("range", "kind").withColumn("entry", begun)
    crossing = parts.join(named, ["range", "kind"]).groupBy("entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", (F.col("kind") == "tail").alias("t"), "text"))), lambda x: x["text"]), "").alias("text"))
    return pieces.where("kind = 'whole'").select("text").unionByName(crossing.select("text")).where(F.trim("text") != "")

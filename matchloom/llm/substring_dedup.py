"""Substring deduplication by hashing units: lines, cut at sentence ends so that passages inside a line are found too.

Units are normalised and reduced to 128-bit digests; only digests are grouped globally. The first place of a digest by
doc_id (null last), then by the row's hash, then by offset, stays and every later one is removed. Offsets are those of
the original text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import drop, lookup, materialize, row_hash, shuffles_freed, ship

#: A unit ends after a sentence's end and spaces, or after a line's end. Units follow each other without gaps.
END = re.compile(r"[.!?][ \t]+|\n")
#: Shorter units go where they repeat together with their neighbours, this many words or more in all: a greeting or a heading alone is no copied passage.
MIN_WORDS = 5
#: Scripts without spaces between words, from Thai to Han: two characters count as a word of a run.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def split_units(text: str) -> list[str]:
    """``text`` in units, in one pass whatever its punctuation."""
    ends = [m.end() for m in END.finditer(text)]
    if len(text) > (ends[-1] if ends else 0):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digest(unit: str, min_words: int) -> bytes | None:
    """128 bits of the unit with A-Z lower-cased and white space collapsed; None if it has fewer words."""
    words = unit.encode().lower().split()
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if len(words) >= min_words else None


def run_digests(units: list[str], min_words: int) -> list[tuple[int, int, int, bytes]]:
    """``(first, unit, also, digest)`` of each shorter unit joined with as few neighbours as give ``min_words`` words.

    Neighbours are those before it, and those after it; units without words count as nothing. ``first`` is where they start.
    Where a unit's neighbours end with one whose neighbours before it start with the unit, both are one: the other is ``also``, else -1.
    """
    full = [(i, w, len(w) + (0 if u.isascii() else len(UNSPACED.findall(u)) // 2)) for i, u in enumerate(units) if (w := u.encode().lower().split())]
    stretches: dict[tuple[int, int], list[int]] = {}
    for at, (i, words, _) in enumerate(full):
        if len(words) >= min_words:
            continue
        for step in (-1, 1):
            end, size = at, full[at][2]
            while size < min_words and 0 <= end + step < len(full):
                end += step
                size += full[end][2]
            if size >= min_words:
                stretches.setdefault((min(at, end), max(at, end)), []).append(i)
                if end == at:
                    break
    out = []
    for (low, high), found in stretches.items():
        joined = b" ".join(w for _, part, _ in full[low : high + 1] for w in part)
        out.append((full[low][0], found[0], found[1] if len(found) > 1 else -1, hashlib.md5(joined, usedforsecurity=False).digest()))
    return out


def cut(units: list[str], gone: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """What is left without the units ``gone``, and the removed spans; a removed end of a longer line leaves its line break."""
    kept, spans, at = [], [], 0
    for i, u in enumerate(units):
        if i in gone:
            whole_line = i == 0 or units[i - 1].endswith("\n")
            size = len(u) - (u.endswith("\n") and not whole_line)
            kept.append(u[size:])
            if spans and spans[-1][1] == at:
                spans[-1] = spans[-1][0], at + size
            else:
                spans.append((at, at + size))
        else:
            kept.append(u)
        at += len(u)
    return "".join(kept), spans


def _units(rows: DataFrame, min_words: int, runs: bool) -> DataFrame:
    """``rows`` has doc_id, text and, if ids are shared, rh. ``also`` is -1, or a second unit that goes with ``unit``."""
    ids = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, text in enumerate(batch.column(len(ids)).to_pylist()):
                # By digest, the place it starts at first: a run's other units may name the same place.
                seen: dict[bytes, int] = {}
                units = split_units(text or "")
                found = [(i, i, -1, d) for i, u in enumerate(units) if (d := digest(u, min_words)) is not None]
                if runs:
                    found = sorted(found + run_digests(units, min_words), key=lambda x: x[0])
                for first, i, also, d in found:
                    for c, v in zip(cols, (k, i, also, d, seen.setdefault(d, first) != first)):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            at, *made = (pa.array(c, k) for c, k in zip(cols, kinds))
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(ids))), *made], [*ids, "unit", "also", "digest", "again"])

    named = ", ".join(f"{c} long" for c in ids)
    return rows.select(*ids, "text").mapInArrow(run, f"{named}, unit int, also int, digest binary, again boolean")


def shared_ids(docs: DataFrame) -> bool:
    """Are there null or repeated doc_ids? Reads nothing but them."""
    with shuffles_freed(docs.sparkSession):
        return not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()


def removed_units(docs: DataFrame, shared: bool, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """``(doc_id, rh, gone)`` for the documents that lose units; without ``shared`` ids, ``(doc_id, gone)``.

    Where ids are shared, a document is named by doc_id and the text's hash; rows equal in both are one document given twice.
    With ``runs``, a shorter unit goes too if it and its neighbours on one side repeat together (:func:`run_digests`).
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([row_hash().alias("rh")] if shared else []), "text")
    units = materialize(_units(rows, min_words, runs), "units")
    with shuffles_freed(docs.sparkSession):
        total = units.count()
    place = F.col("doc_id")
    if shared:  # slower, as structs are aggregated by sorting
        place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.col("rh"))
    groups = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    hit = lookup(units, groups, "digest", "n", total)
    gone = hit.where((place != F.col("first")) | F.col("again"))
    both = gone.select("doc_id", *(["rh"] if shared else []), F.explode(F.filter(F.array("unit", "also"), lambda x: x >= 0)).alias("unit"))
    # Written before texts are shuffled, so that the units' shuffles and their table are gone by then.
    found = materialize(both.groupBy("doc_id", *(["rh"] if shared else [])).agg(F.collect_set("unit").alias("gone")), "gone")
    drop(units)
    return found


def _cut_rows(docs: DataFrame, min_words: int, runs: bool = False) -> DataFrame:
    """The columns of ``docs`` and, last, the numbers of the units that go."""
    unused = "gone" + "_" * (1 + max(map(len, docs.columns)))
    shared = shared_ids(docs)
    gone = removed_units(docs, shared, min_words, runs).toDF("d", *(["r"] if shared else []), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("k"), *([row_hash().alias("h")] if shared else []))
    return rows.join(gone.hint("shuffle_hash"), F.expr("k <=> d AND h = r" if shared else "k = d"), "left").select("row.*", F.col("gone").alias(unused))


def substring_report(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_units, n_removed, n_removed_chars, kept_sha256, spans (removed, in code points of the original).

    Null texts have no units. Rows equal in doc_id and text are one document given twice: both keep what it keeps.
    An empty table gives no rows; other columns are ignored, whatever their names. ``runs`` as in :func:`removed_units`.
    """
    joined = _cut_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words, runs)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                units = split_units(text or "")
                kept, spans = cut(units, set(gone or ()))
                rows.append((len(units), len(gone or ()), sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = zip(*rows) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_units", "n_removed", "n_removed_chars", "kept_sha256", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_units long, n_removed long, n_removed_chars long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """``docs`` with its columns and the removed units cut from ``text``; null texts stay null. ``runs`` as in :func:`removed_units`.

    An empty table stays empty; columns may have any names.
    """
    joined = _cut_rows(docs, min_words, runs)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [t if not gone else cut(split_units(t), set(gone))[0] for t, gone in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist())]
            cols = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)


def spans_text(spans: str | Column = "spans") -> Column:
    """Spans as "start-end", comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")


def report_sql(min_words: int = MIN_WORDS) -> str:
    """The report with ``runs`` in DuckDB's SQL, its spans as :func:`spans_text` writes them."""
    steps = range(min_words)

    def reach(side: str) -> str:
        """The number of neighbours needed on one side; null if there aren't enough."""
        sums = [" + ".join(["size", *(f"{side}(size, {j}) OVER w" for j in range(1, k + 1))]) for k in steps]
        return "CASE " + " ".join(f"WHEN {x} >= {min_words} THEN {k}" for k, x in zip(steps, sums)) + " END"

    def text(side: str, k: int, ahead: bool) -> str:
        parts = ["norm", *(f"{side}(norm, {j}) OVER w" for j in range(1, k + 1))]
        return " || ' ' || ".join(parts if ahead else parts[::-1])

    def chosen(side: str, ahead: bool) -> str:
        return "CASE " + " ".join(f"WHEN {'after' if ahead else 'before'}_n = {k} THEN {text(side, k, ahead)}" for k in steps) + " END"

    starts = "CASE " + " ".join(f"WHEN before_n = {k} THEN {'i' if k == 0 else f'lag(i, {k}) OVER w'}" for k in steps) + " END"
    return rf"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_extract_all(coalesce(text, ''), '[^\n]*?(?:[.!?]+[ \t]+|\n|\z)'), lambda u: len(u) > 0) AS units FROM documents),
u AS (SELECT doc_id, units, unnest(range(len(units))) AS i FROM d),
n AS (
  SELECT doc_id, i, units[i + 1] AS unit, CASE WHEN i > 0 THEN units[i] ELSE chr(10) END AS before,
    trim(regexp_replace(translate(units[i + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM u
), f AS (
  SELECT doc_id, i, norm, len(string_split(norm, ' ')) AS words, len(string_split(norm, ' '))
    + len(regexp_extract_all(unit, '[\x{{0e00}}-\x{{0eff}}\x{{1000}}-\x{{109f}}\x{{1780}}-\x{{17ff}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{2ffff}}]')) // 2 AS size
  FROM n WHERE norm <> ''
), g1 AS (
  SELECT *, {reach("lag")} AS before_n, {reach("lead")} AS after_n FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g2 AS (
  SELECT doc_id, i, words, norm, before_n, after_n, {starts} AS before_start, {chosen("lag", False)} AS before_text, {chosen("lead", True)} AS after_text
  FROM g1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), e AS (
  SELECT doc_id, i, i AS start, norm AS t FROM f WHERE words >= {min_words}
  UNION ALL SELECT doc_id, i, before_start, before_text FROM g2 WHERE words < {min_words} AND before_n IS NOT NULL
  UNION ALL SELECT doc_id, i, i, after_text FROM g2 WHERE words < {min_words} AND after_n IS NOT NULL
), k AS (
  SELECT t, min({{'d': doc_id, 's': start}}) AS first FROM e GROUP BY t
), x AS (
  SELECT DISTINCT doc_id, i FROM e JOIN k USING (t) WHERE first.d <> doc_id OR first.s <> start
), r AS (
  SELECT n.*, x.i IS NOT NULL AS gone FROM n LEFT JOIN x ON x.doc_id = n.doc_id AND x.i = n.i
), c AS (
  SELECT *, CASE WHEN NOT gone THEN unit WHEN unit LIKE '%' || chr(10) AND before NOT LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS kept FROM r
), o AS (
  SELECT doc_id, i, gone, sum(len(unit)) OVER (PARTITION BY doc_id ORDER BY i) - len(unit) AS first, len(unit) - len(kept) AS size FROM c
), s AS (
  SELECT doc_id, i, first, first + size AS stop, CASE WHEN lag(first + size) OVER (PARTITION BY doc_id ORDER BY i) = first THEN 0 ELSE 1 END AS fresh FROM o WHERE gone
), m AS (
  SELECT doc_id, CAST(min(first) AS BIGINT) AS a, CAST(max(stop) AS BIGINT) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s) GROUP BY doc_id, island
), l AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM m GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, sum(len(unit) - len(kept)) AS n_removed_chars, string_agg(kept, '' ORDER BY i) AS kept FROM c GROUP BY doc_id
)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_removed_chars, 0) AS BIGINT) AS n_removed_chars, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN l ON d.doc_id = l.doc_id"""

"""Near-duplicate lines by MinHash over character shingles; one line of each component stays.

Equal lines (after lower-casing A-Z and collapsing white space) are one node. Signatures are banded; in a
bucket every line is first compared with the line that has the most copies, which joins most of a group of near
copies at linear cost. Only buckets that still hold several components are compared in full, inside a task,
with components growing as they are found; buckets too large for a task are compared in blocks, where no line of the
largest component meets another of it. Every link rests on the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import drop, lookup, materialize, row_hash, ship
from .components import connected_components

#: Code points of a shingle, a power of two.
SHINGLE = 8
#: At a similarity of 0.8 a pair shares one of 10 bands of 4 with probability 0.995.
BANDS, ROWS = 10, 4
THRESHOLD = 0.8
#: Lines that one task compares with each other.
DIRECT = 2_000
#: Groups of up to this many lines are compared set by set.
FEW = 24
#: Code points that are hashed at once, and shingles that go through the hash functions at once.
PIECE, BLOCK = 1 << 20, 1 << 16

_MULTIPLY = np.random.default_rng(7).integers(0, 1 << 31, 256, np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = 0xD6E8FEB86659FD93

#: Of a list: all 64-bit shingle hashes, each item's first index and number.
Hashes = Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]


_PLAIN = bytes(32 if c in b"\t\x0b\x0c\r" else c for c in bytes(range(256)).lower())


def normalize(line: bytes) -> bytes:
    """ASCII letters lower-cased, white space collapsed and stripped; b"" for a blank line."""
    return b" ".join(line.lower().split())


def normal_lines(text: bytes | None) -> list[tuple[int, bytes]]:
    """``(number, normalized line)`` of the lines that aren't blank."""
    lines = (text or b"").translate(_PLAIN).split(b"\n")
    return [(no, x) for no, line in enumerate(lines) if (x := b" ".join(line.split()) if b"  " in line else line.strip(b" "))]


def _rolled(lines: list[str] | list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A polynomial of the code points of each shingle in ``kind``, by doubling; then as :func:`shingle_hashes`."""
    lines = [x.decode() if isinstance(x, bytes) else x for x in lines]
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.array([len(x) for x in padded])
    h, size = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(kind), 1
    while size < SHINGLE:
        h = h[:-size] * kind(pow(_BASE, size, 1 << 8 * h.itemsize)) + h[size:]
        size *= 2
    return h, np.cumsum(sizes) - sizes, sizes - SHINGLE + 1


def shingle_hashes(lines: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of ``lines``, with each line's first index and number; a shorter line is one shingle."""
    h, first, n = _rolled(lines, np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return h, first, n


def band_keys(lines: list[str] | list[bytes], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of shape (lines, bands): equal in a band if its ``rows`` minima are equal. Signatures need 32 bits of hash only."""
    ends = np.cumsum([len(x) for x in lines])
    out, a = [np.zeros((0, bands), np.uint64)], 0
    while a < len(lines):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * BLOCK, "right")))
        x, first, n = _rolled(lines[a:b], np.uint32)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        out.append(minima_keys(x, first, n, bands, rows))
        a = b
    return np.concatenate(out)


def hashed_keys(h: np.ndarray, first: np.ndarray, n: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """:func:`band_keys` of items whose 64-bit hashes are given."""
    return minima_keys((h >> np.uint64(32)).astype(np.uint32), first, n, bands, rows)


def minima_keys(x: np.ndarray, first: np.ndarray, n: np.ndarray, bands: int, rows: int) -> np.ndarray:
    ends = np.cumsum(n)
    starts = ends - n
    if len(x) > ends[-1]:  # without what lies between the lines
        edge = np.zeros(len(x) + 1, np.int8)
        edge[first] += 1
        edge[first + n] -= 1
        x = x[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    out = np.zeros((len(n), bands), np.uint64)
    held = np.empty(BLOCK + int(n.max()), np.uint32)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
        part, cuts = x[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
        y = held[: len(part)]
        for i in range(bands * rows):
            # An odd factor permutes the 32-bit numbers.
            np.multiply(part, _MULTIPLY[i], out=y)
            k = out[a:b, i // rows]
            k += np.minimum.reduceat(y, cuts)
            k *= np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        a = b
    return out


def linked(a: set, b: set, threshold: float = THRESHOLD) -> bool:
    """Is the exact Jaccard similarity of two sets at the threshold?"""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(a & b)
    return common >= threshold * (len(a) + len(b) - common)


def few_stars(keys: list[int], sets: list[set], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """:func:`similar_stars` of a small group."""
    out, unseen = [], list(range(len(keys)))
    while len(unseen) > 1:
        top, unseen = unseen[0], unseen[1:]
        queue = [top]
        while queue and unseen:
            i = queue.pop()
            hit = [j for j in unseen if linked(sets[i], sets[j], threshold)]
            if hit:
                out += [(keys[top], keys[j]) for j in hit]
                queue += hit
                unseen = [j for j in unseen if j not in hit]
    return out


def similar_stars(keys: list[int], sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """A star (first, other) for each component of lines linked at the threshold. ``sets`` has each line's different hashes."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    out, unseen, mark = [], np.arange(len(sets)), np.zeros(ids.max() + 1, bool)
    while len(unseen) > 1:
        top, unseen = unseen[0], unseen[1:]
        queue = [top]
        while queue and len(unseen):
            i = queue.pop()
            close = unseen[(sizes[unseen] >= threshold * sizes[i]) & (sizes[i] >= threshold * sizes[unseen])]
            if not len(close):
                continue
            mark[ids[starts[i] : starts[i] + sizes[i]]] = True
            at = np.concatenate([ids[starts[j] : starts[j] + sizes[j]] for j in close])
            common = np.add.reduceat(mark[at].astype(np.int64), np.cumsum(sizes[close]) - sizes[close])
            mark[:] = False
            hit = close[common >= threshold * (sizes[i] + sizes[close] - common)]
            if len(hit):
                out += [(keys[top], keys[j]) for j in hit]
                queue += hit.tolist()
                unseen = np.setdiff1d(unseen, hit, assume_unique=True)
    return out


def _lines(rows: DataFrame) -> DataFrame:
    """A row per line that isn't blank: doc_id, rh, line_no, lid and its band keys b0, b1, ...

    The keys are null where a line was seen just before: signatures are made once per batch.
    """
    import xxhash

    names = [f"b{i}" for i in range(BANDS)]

    def pieces(batch):
        held, size = [], 0
        for i in range(0, batch.num_rows, 500):
            for doc_id, rh, text in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                for no, line in normal_lines(text):
                    held.append((doc_id, rh, no, line))
                    size += len(line)
                    if size >= PIECE:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def run(batches):
        for batch in batches:
            for held in pieces(batch):
                doc_id, rh, no, lines = zip(*held)
                at: dict[bytes, int] = {}
                place = [at.setdefault(x, len(at)) for x in lines]
                lid = np.fromiter(map(xxhash.xxh3_64_intdigest, at), np.uint64, len(at)).view(np.int64)[place]
                keys = band_keys(list(at)).view(np.int64)
                _, first = np.unique(place, return_index=True)
                again = np.ones(len(place), bool)
                again[first] = False
                from_keys = pa.array(place, pa.int64(), mask=again)
                cols = [pa.array(doc_id, pa.int64()), pa.array(rh, pa.int64()), pa.array(no, pa.int32()), pa.array(lid)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(keys[:, i])).take(from_keys) for i in range(BANDS))], ["doc_id", "rh", "line_no", "lid", *names])

    schema = "doc_id long, rh long, line_no int, lid long" + "".join(f", {b} long" for b in names)
    return rows.select("doc_id", "rh", F.col("text").cast("binary")).mapInArrow(run, schema)


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(lid, line)`` for the lids in ``wanted``."""
    import xxhash

    def run(batches):
        for batch in batches:
            lines = list({x for text in batch.column(0).to_pylist() for _, x in normal_lines(text)})
            lids = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(lines, pa.binary())], ["lid", "line"])

    every = rows.select(F.col("text").cast("binary")).mapInArrow(run, "lid long, line binary")
    return every.join(wanted.hint("shuffle_hash"), "lid", "left_semi").dropDuplicates(["lid"])


class _Sets:
    """The shingle sets of lines by id, each made once."""

    def __init__(self, lines: dict[int, bytes], hashes: Hashes):
        h, first, n = hashes(list(lines.values()))
        self.h, self.at, self.made = h, {k: (int(a), int(a + m)) for k, a, m in zip(lines, first, n)}, {}

    def __getitem__(self, key: int) -> set:
        if key not in self.made:
            a, b = self.at[key]
            self.made[key] = set(self.h[a:b].tolist())
        return self.made[key]

    def array(self, key: int) -> np.ndarray:
        a, b = self.at[key]
        return np.unique(self.h[a:b])


def _ranges(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes come to ``most`` at most, or of one larger item."""
    ends, out, i = np.cumsum(sizes), [], 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        out.append((i, j))
        i = j
    return out


def _bytes(lines: pa.Array) -> np.ndarray:
    return pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _linked_pairs(pairs: DataFrame, hashes: Hashes) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` (a, b, a_line, b_line) that are linked."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _ranges(_bytes(batch.column(2)) + _bytes(batch.column(3)), PIECE // 4):
                part = batch.slice(i, j - i)
                sets = _Sets(dict(zip(a[i:j] + b[i:j], part.column(2).to_pylist() + part.column(3).to_pylist())), hashes)
                good = [linked(sets[x], sets[y]) for x, y in zip(a[i:j], b[i:j])]
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "a_line", "b_line").mapInArrow(run, "a long, b long")


def _stars(groups: DataFrame, hashes: Hashes) -> DataFrame:
    """Edges within each array of (lid, line)."""

    def held(batch):
        """Groups of a bounded number of bytes, or one larger group."""
        lids, lines = batch.column(0).flatten().field("lid").to_pylist(), batch.column(0).flatten().field("line")
        ends = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
        upto = np.concatenate([[0], np.cumsum(_bytes(lines))])[ends]
        for i, j in _ranges(np.diff(upto, prepend=0), PIECE // 4):
            cuts = [int(ends[i - 1]) if i else 0, *ends[i:j].tolist()]
            texts = lines.slice(cuts[0], cuts[-1] - cuts[0]).to_pylist()
            yield [lids[x:y] for x, y in zip(cuts, cuts[1:])], dict(zip(lids[cuts[0] : cuts[-1]], texts))

    def run(batches):
        for batch in batches:
            pairs = []
            for members, lines in held(batch):
                sets = _Sets(lines, hashes)
                for ids in members:
                    pairs += few_stars(ids, [sets[x] for x in ids]) if len(ids) <= FEW else similar_stars(ids, [sets.array(x) for x in ids])
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame, direct: int) -> DataFrame:
    """``members`` (k, lid, size, rest, big) dealt so that tasks of at most two blocks see every pair but those of one component.

    ``big`` marks the bucket's largest component. Each line outside it meets every line of the bucket.
    """
    block = lambda n: F.pmod(F.xxhash64("lid"), F.ceil(n / (direct // 2)))
    rest_blocks = F.ceil(F.col("rest") / (direct // 2))
    own = members.withColumn("own", F.when(F.col("big"), -1 - block(F.col("size") - F.col("rest"))).otherwise(block(F.col("rest"))))
    every = F.sequence(F.lit(0).cast("long"), rest_blocks - 1)
    met = own.withColumn("o", F.explode(every)).select(
        "lid", F.xxhash64("k", F.when(F.col("big"), F.col("o")).otherwise(F.least("own", "o")), F.when(F.col("big"), F.col("own")).otherwise(F.greatest("own", "o"))).alias("k")
    )
    big_blocks = F.ceil((F.col("size") - F.col("rest")) / (direct // 2)).cast("int")
    # Spark hashes INT and BIGINT differently: all parts of the keys are BIGINT.
    asked = own.where("NOT big AND size > rest").withColumn("b", F.explode(F.sequence(F.lit(1), big_blocks))).select("lid", F.xxhash64("k", "own", -F.col("b").cast("long")).alias("k"))
    return met.unionByName(asked)


def line_roots(rows: DataFrame, nodes: DataFrame, direct: int = DIRECT) -> DataFrame:
    """``(lid, root)`` of the lines that are linked to another, by all verified candidates."""
    return verified_roots(nodes, lambda wanted: _texts(rows, wanted), direct)


def verified_roots(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], direct: int, hashes: Hashes = shingle_hashes) -> DataFrame:
    """``(lid, root)``: the components of ``nodes`` (lid, n, b0, b1, ...) that share a band and are linked, but for single ones.

    ``texts_of`` gives ``(lid, line)`` for the lids of a table, and ``hashes`` the shingles of a list of lines,
    as :func:`shingle_hashes` does.
    """
    keyed = nodes.select("lid", "n", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("k"))
    in_bucket = keyed.withColumn("size", F.count("*").over(Window.partitionBy("k"))).where("size > 1")
    members = materialize(in_bucket, "members")
    wanted = members.select("lid").distinct()
    texts = materialize(texts_of(wanted), "texts")
    # Each line against one center, the line with the most copies that it shares a bucket with.
    rank = F.struct(F.col("n"), -F.col("lid"))
    centers = members.groupBy("k").agg(F.max(rank).alias("c"))
    pairs = members.join(centers, "k").groupBy("lid").agg((-F.max("c")["col2"]).alias("center")).where("lid != center")
    both = pairs.join(texts.toDF("lid", "b_line"), "lid").join(texts.toDF("center", "a_line"), "center")
    first = materialize(_linked_pairs(both.withColumnsRenamed({"center": "a", "lid": "b"}), hashes), "first")
    roots = materialize(connected_components(first), "roots")
    # What buckets still hold of different components.
    labelled = members.select("k", "lid").join(roots.toDF("lid", "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    mixed = labelled.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 != r1")
    open_ = materialize(labelled.join(mixed.select("k", "size"), "k"), "open")
    dealt = open_.where(F.col("size") <= direct).select("k", "lid")
    large = open_.where(F.col("size") > direct)
    if not large.isEmpty():
        shares = large.groupBy("k", "root").agg(F.count("*").alias("share"))
        top = shares.groupBy("k").agg(F.max(F.struct("share", "root")).alias("top"))
        sided = large.join(top, "k").select("k", "lid", "size", (F.col("size") - F.col("top.share")).alias("rest"), (F.col("root") == F.col("top.root")).alias("big"))
        dealt = dealt.unionByName(_in_blocks(sided, direct).select("k", "lid"))
    # A group of near copies shares most of its bands: the same members are compared once.
    alike = dealt.groupBy("k").agg(F.xxhash64(F.sort_array(F.collect_list("lid"))).alias("members")).groupBy("members").agg(F.min("k").alias("k"))
    groups = dealt.join(alike, "k", "left_semi").join(texts, "lid").groupBy("k").agg(F.collect_list(F.struct("lid", "line")).alias("members"))
    more = materialize(_stars(groups, hashes), "more")
    # Further links join what the first round has found: only its roots are nodes now.
    named = lambda c: roots.toDF(c, f"{c}_root")
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = materialize(connected_components(ends), "tops")
    upper = tops.toDF("root", "top")
    every = roots.toDF("lid", "root").join(upper, "root", "left").select("lid", F.coalesce("top", "root").alias("root"))
    found = materialize(every.unionByName(tops.toDF("lid", "root")).distinct(), "found")
    drop(members, texts, first, roots, open_, more, tops)
    return found


def _with_rh(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rh", row_hash())


def removed_lines(docs: DataFrame, direct: int = DIRECT) -> DataFrame:
    """``(doc_id, rh, removed, components)`` for the documents that lose lines: line numbers from 0 and the lines' components.

    The first line of a component by doc_id, then by number, stays; null doc_ids come last and count as one
    document. Blank lines belong to no component. Rows equal in doc_id and text are one document given twice.
    """
    ship(docs.sparkSession)
    rows = _with_rh(docs)
    # Keys are random numbers: a dictionary of them would only cost time.
    lines = materialize(_lines(rows), "lines", **{f"parquet.enable.dictionary#{c}": "false" for c in ("lid", *(f"b{i}" for i in range(BANDS)))})
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc")
    keys = [F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)]
    nodes = materialize(lines.select("lid", last, *(f"b{i}" for i in range(BANDS))).groupBy("lid").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), *keys), "nodes")
    roots = line_roots(rows, nodes, direct)
    named = nodes.select("lid", "n", "doc").join(roots, "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    named = materialize(named, "named")
    whole = named.groupBy("root").agg(F.min("doc").alias("doc"), F.sum("n").alias("all"), F.count("*").alias("lids")).where("all > 1")
    total = lines.count()
    dup = materialize(lookup(named.select("lid", "n", "root"), whole, "root", "lids", total).select("lid", "n", "root", F.col("doc").alias("first_doc")), "dup")
    hit = materialize(lookup(lines.select("doc_id", "rh", "line_no", "lid", last), dup, "lid", "n", total).drop("lid", "n"), "hit")
    drop(lines, nodes, named, dup)
    at_first = hit.where("doc = first_doc")
    # Within the first document only, so a window's rows are bounded by a text. Copies of the row all keep the line.
    order = Window.partitionBy("root").orderBy("line_no", "rh")
    least = at_first.withColumn("least", F.first("line_no").over(order)).withColumn("least_rh", F.first("rh").over(order))
    gone = least.where("line_no != least OR rh != least_rh").select("doc_id", "rh", "line_no", "root").unionByName(hit.where("doc != first_doc").select("doc_id", "rh", "line_no", "root"))
    per_doc = gone.distinct().groupBy("doc_id", "rh").agg(F.sort_array(F.collect_list(F.struct("line_no", "root"))).alias("gone"))
    return per_doc.select("doc_id", "rh", F.col("gone.line_no").alias("removed"), F.col("gone.root").alias("components"))


def line_report(docs: DataFrame, direct: int = DIRECT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (not blank), n_removed, removed (line numbers) and components (of these lines).

    Null and empty texts have no lines. An empty table gives no rows; columns besides doc_id and text are ignored, whatever their names.
    """
    removed = removed_lines(docs, direct)
    filled = r"(?dm)^[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]"
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rh"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(filled)).alias("n_lines"))
    r = removed.withColumnsRenamed({"doc_id": "d", "rh": "r"})
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return sizes.join(r, F.expr("doc_id <=> d AND rh = r"), "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), none("removed", "array<int>").alias("removed"), none("components", "array<long>").alias("components")
    )


def dedup_lines(docs: DataFrame, direct: int = DIRECT) -> DataFrame:
    """``docs`` with its columns, without the lines that went; a document that has lost all of them keeps its row with an empty text.

    Null texts stay null. An empty table stays empty; columns may have any names.
    """
    removed = removed_lines(docs, direct).toDF("d", "r", "gone", "components").drop("components")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("k"), row_hash().alias("h"))
    lines = F.split("row.text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    joined = rows.join(removed.hint("shuffle_hash"), F.expr("k <=> d AND h = r"), "left")
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")

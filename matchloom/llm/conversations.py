"""Conversation structure repair: cheapest edits that make a conversation's roles alternate.

The places between rows times four states (nothing yet, after the system row, after a user row, after an assistant row)
are the nodes of a graph, the edits its arcs. Costs are small integers, so distances to the end come from Dial's bucket queue;
from the start, the walk along tight arcs takes the least letter at every node and so gives the least of the cheapest audits.

A conversation of a common size is solved whole, streamed from partitions sorted by conversation. One that holds more than its
share of all rows is cut into pieces by range partitioning: pieces give their distances between states, these are combined
from the end, and each piece is walked from every state it may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import HOT_ROWS, HOT_SHARE, drop, lookup, materialize, ship

SPACE = " \t\n\r\x0b\x0c"
#: A row is a byte: the place of its role's initial in " sua", and these.
GO, CUT_OFF = 4, 8
#: By state: the state after keeping a row of each initial, that after a user or assistant row put in, and the cost of ending here.
KEEP = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
NEXT = (2, 2, 3, 2)
ENDS = (0, 10, 5, 0)
#: Costs of the edits, and of a row that stays truncated.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
EMPTY = hashlib.sha256(b"").hexdigest()

OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def distances(rows: bytes, ends: Iterable[int] = ENDS) -> list[int]:
    """By 4 * place + state: the cost of getting from there to the end, where state s costs ``ends[s]`` more. Dial's queue."""
    n, ends = len(rows), list(ends)
    dist = [FAR] * (4 * n + 4)
    dist[4 * n :] = ends
    low = min(ends)
    buckets: list[list[int]] = []

    def push(node: int, d: int) -> None:
        while len(buckets) <= d - low:
            buckets.append([])
        buckets[d - low].append(node)

    def relax(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            push(node, d)

    for s, d in enumerate(ends):
        if d < FAR:
            push(4 * n + s, d)
    now = 0
    while now < len(buckets):
        for node in buckets[now]:  # may grow meanwhile: keeping costs nothing
            d = now + low
            if dist[node] != d:
                continue
            i, state = divmod(node, 4)
            for before in range(4):
                if NEXT[before] == state:
                    relax(4 * i + before, d + INSERT)
            if i:
                row = rows[i - 1]
                relax(node - 4, d + DELETE)
                if not row & GO:
                    more = d + (TRUNCATED if row & CUT_OFF else 0)
                    for before in range(4):
                        if KEEP[before][row & 3] == state:
                            relax(4 * i - 4 + before, more)
                        if NEXT[before] == state:
                            relax(4 * i - 4 + before, more + REROLE)
        buckets[now] = []
        now += 1
    return dist


def walk(rows: bytes, dist: list[int], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from ``state`` before the first row until the last row is done, and the state then."""
    out, i = [], 0
    while i < len(rows):
        row, here, after = rows[i], dist[4 * i + state], 4 * i + 4
        more = TRUNCATED if row & CUT_OFF else 0
        if dist[after + state] + DELETE == here:
            out.append("D")
            i += 1
        elif dist[4 * i + NEXT[state]] + INSERT == here:
            out.append("I")
            state = NEXT[state]
        elif (kept := KEEP[state][row & 3]) >= 0 and dist[after + kept] + more == here:
            out.append("K")
            state = kept
            i += 1
        else:
            out.append("R")
            state = NEXT[state]
            i += 1
    return "".join(out), state


def ending(state: int) -> str:
    """The rows put in after the last one."""
    return "I" * (ENDS[state] // INSERT)


class Replay:
    """SHA-256 of the repaired rows, ``role:text`` joined by line breaks, as edits come."""

    def __init__(self):
        self.state, self.hash, self.any = 0, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def put(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "K":
            self._add(role, text)
            self.state = KEEP[self.state][initial(role)]
        elif letter != "D":
            self._add("assistant" if self.state == 2 else "user", text)
            self.state = NEXT[self.state]


def initial(role: str) -> int:
    return max(0, " sua".find(role[0])) if role else 0


def fault(text: str, again: bool) -> str:
    """The row's first fault, by its first letter."""
    end = text.rstrip(SPACE)[-1:]
    return "b" if not end else "d" if again else "" if end in ".!?" else "t"


def as_byte(role: str, fault: str) -> int:
    return initial(role) | (GO if fault in ("b", "d") else 0) | (CUT_OFF if fault == "t" else 0)


def illegal(kinds: bytes) -> int:
    """Neighbours whose initials aren't su, ua or au."""
    return sum((a & 3, b & 3) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(kinds, kinds[1:]))


def as_long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return as_long(max(known) - min(known) + 1 - len(known)) if known else 0


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The report on a conversation's rows (turn, role, text) in order."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", EMPTY
    seen, faults = set(), []
    for _, role, text in rows:
        size = len(seen)
        seen.add((role, text))
        faults.append(fault(text, len(seen) == size))
    kinds = bytes(as_byte(r[1], f) for r, f in zip(rows, faults))
    dist = distances(kinds)
    letters, state = walk(kinds, dist, 0)
    audit, replay, at = letters + ending(state), Replay(), iter(rows)
    for letter in audit:
        replay.put(letter, *(("", "") if letter == "I" else next(at)[1:]))
    return gaps(r[0] for r in rows), faults.count("b"), faults.count("d"), faults.count("t"), illegal(kinds), dist[0], audit, replay.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after damage; what damage drops has no copies. Null roles and texts are one space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") < 2, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _batch(kind: pa.DataType, found: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in f"conv_id x, {OUT}".split(", ")]
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 9, kinds)], names)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that fit a task, one after the other from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind, now, held, found = first.column(0).type, None, None, []

        def every():
            yield first
            yield from batches

        for conv, turn, role, text, copies in _streamed(every()):
            if held is None or conv != now:
                if held is not None:
                    found.append((now, *repair(held)))
                now, held = conv, []
                if len(found) >= 1000:
                    yield _batch(kind, found)
                    found = []
            held += [(turn, role, text)] * copies
        if held is not None:
            found.append((now, *repair(held)))
        yield _batch(kind, found)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, {OUT}")


def _cut(rows: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Conversations that don't fit a task: ``rows`` has ``key``, their conversation as text; ``ids`` has it with conv_id.

    Only the last step, a SHA-256 that can't be taken in parts, reads a conversation in one task, row after row.
    """
    same = F.md5(F.concat_ws(":", "key", F.length("role"), F.concat("role", "text")))
    # Rows equal in turn, role and text stand together: one row with a count, so that none of them is a hot range.
    merged = materialize(rows.where("copies > 0").groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("same", same), "merged")
    first = merged.groupBy("same").agg(F.count("*").alias("rows"), F.max(F.col("turn").isNull()).alias("z"), F.min("turn").alias("low"))
    again = F.expr("turn IS NOT NULL AND (z OR turn > low)")
    marked = lookup(merged, first, "same", "rows", merged.count()).select("key", "turn", "role", "text", "n", again.alias("again"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            kinds = [[fault(t, a) for t, a in zip(b.column(3).to_pylist(), b.column(5).to_pylist())], [fault(t, True) for t in b.column(3).to_pylist()]]
            roles = b.column(2).to_pylist()
            cols = [pa.array([as_byte(r, f) for r, f in zip(roles, k)], pa.int32()) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([piece] * len(roles), pa.int32()), pa.array(range(seq, seq + len(roles)), pa.int64()), *cols, pa.array(kinds[0], pa.string())], ["key", "turn", "role", "text", "n", "piece", "seq", "kind", "more", "fault"])
            seq += len(roles)

    order = ["key", "turn", "role", "text"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "key string, turn long, role string, text string, n long, piece int, seq long, kind int, more int, fault string")
    table = materialize(ordered, "ordered")
    drop(merged)

    def bytes_of(p: pd.DataFrame) -> bytes:
        return b"".join(bytes([k]) + bytes([m]) * (n - 1) for k, m, n in zip(p["kind"], p["more"], p["n"]))

    def summary(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        kinds, turns = bytes_of(p), p["turn"][p["known"]]
        count = lambda f: int(((p["fault"] == f) * (p["n"] if f == "b" else 1)).sum())
        between = [distances(kinds, [0 if s == t else FAR for s in range(4)])[:4] for t in range(4)]
        again = int(((p["fault"] != "b") * (p["n"] - 1)).sum())
        known = len(turns) > 0  # longs with nulls would become doubles in pandas
        return pd.DataFrame([{
            "key": p["key"].iloc[0], "piece": p["piece"].iloc[0], "kinds": kinds, "between": [x for d in between for x in d],
            "blank": count("b"), "duplicate": count("d") + again, "truncated": count("t"), "illegal": illegal(kinds),
            "low": turns.iloc[0] if known else 0, "high": turns.iloc[-1] if known else 0, "turns": turns.nunique(),
        }])

    small = "key string, piece int, kinds binary, between array<long>, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
    pieces = materialize(table.select("key", "piece", "seq", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "n", "kind", "more", "fault").groupBy("key", "piece").applyInPandas(summary, small), "pieces")

    def combine(p: pd.DataFrame) -> pd.DataFrame:
        """From the last piece on: what each state at a piece's end still costs."""
        p, after, out = p.sort_values("piece"), list(ENDS), []
        for piece, between in zip(p["piece"].iloc[::-1], p["between"].iloc[::-1]):
            out.append((p["key"].iloc[0], piece, after))
            after = [min(min(between[4 * t + s] + after[t] for t in range(4)), FAR) for s in range(4)]
        return pd.DataFrame(out, columns=["key", "piece", "ends"])

    ends = pieces.select("key", "piece", "between").groupBy("key").applyInPandas(combine, "key string, piece int, ends array<long>")

    def walks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for key, piece, kinds, after in zip(p["key"], p["piece"], p["kinds"], p["ends"]):
                dist = distances(kinds, [int(x) for x in after])
                found = [walk(kinds, dist, s) if dist[s] < FAR else ("", -1) for s in range(4)]
                out.append((key, piece, dist[0], [f[0] for f in found], [f[1] for f in found]))
            yield pd.DataFrame(out, columns=["key", "piece", "cost", "letters", "exits"])

    walked = pieces.join(ends, ["key", "piece"]).select("key", "piece", "kinds", "ends").mapInPandas(walks, "key string, piece int, cost long, letters array<string>, exits array<int>")

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        p, state, audit = p.sort_values("piece"), 0, []
        kinds, high, wrong, turns = b"", None, 0, 0
        for letters, exits, ends, low, top, n in zip(p["letters"], p["exits"], p["kinds"], p["low"], p["high"], p["turns"]):
            audit.append(letters[state])
            state = int(exits[state])
            wrong += illegal(kinds + ends[:1]) if kinds else 0
            kinds = ends[-1:]
            turns += int(n) - (high is not None and n > 0 and low == high)
            high = top if n > 0 else high
        known = p[p["turns"] > 0]
        gap = as_long(int(known["high"].iloc[-1]) - int(known["low"].iloc[0]) + 1 - turns) if len(known) else 0
        sums = {c: int(p[c].sum()) for c in ("blank", "duplicate", "truncated")}
        return pd.DataFrame([{"key": p["key"].iloc[0], "gaps": gap, **sums, "illegal": int(p["illegal"].sum()) + wrong, "cost": int(p["cost"].iloc[0]), "audit": "".join(audit) + ending(state)}])

    # The first and the last byte are what neighbouring pieces need.
    edges = pieces.withColumn("kinds", F.concat(F.expr("substring(kinds, 1, 1)"), F.expr("substring(kinds, -1, 1)"))).drop("between").join(walked, ["key", "piece"])
    heads = materialize(edges.groupBy("key").applyInPandas(compose, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "heads")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, replay, letters = None, None, iter("")

        def done():
            for letter in letters:
                replay.put(letter)
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([replay.hash.hexdigest()])], ["key", "repaired_sha256"])

        for k, piece, role, text, n, audit in _streamed(batches):
            if piece < 0:
                if replay:
                    yield done()
                key, replay, letters = k, Replay(), iter(audit)
                continue
            for _ in range(n):
                while (letter := next(letters)) == "I":
                    replay.put(letter)
                replay.put(letter, role, text)
        if replay:
            yield done()

    stream = table.select("key", "piece", "seq", "role", "text", "n", F.lit(None).cast("string").alias("audit"))
    head = heads.select("key", F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    hashed = stream.unionByName(head).repartition("key").sortWithinPartitions("key", "piece", "seq").select("key", "piece", "role", "text", "n", "audit").mapInArrow(sums, "key string, repaired_sha256 string")
    full = heads.join(hashed, "key").select("key", *[x.split()[0] for x in OUT.split(", ")])
    none = {x.split()[0]: (EMPTY if "sha" in x else "" if "audit" in x else 0) for x in OUT.split(", ")}
    return ids.join(full, "key", "left").na.fill(none).select("conv_id", *none)


def repair_conversations(conversations: DataFrame, longest: int | None = None) -> DataFrame:
    """Per conv_id of ``conversations`` (conv_id, turn, role, text), damaged first: gaps, faults, cost, audit, repaired_sha256.

    Rows stand by turn, nulls first; rows of one turn by role and text. Null conv_ids are one conversation, null roles and texts
    one space. A role that doesn't start with s, u or a can't be kept, an empty one neither. Repeated rows are rows. An empty
    table gives no rows; other columns are ignored. Conversations of over ``longest`` rows (by default one of HOT_SHARE
    of all rows, HOT_ROWS at least) are cut into pieces, with the same result.
    """
    ship(conversations.sparkSession)
    kind = dict(conversations.dtypes)["conv_id"]
    rows = damaged(conversations)
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    total = conversations.count()
    hot = materialize(sizes.where(F.col("n") > (max(HOT_ROWS, total // HOT_SHARE) if longest is None else longest)).select("conv_id"), "long")
    if hot.isEmpty():
        drop(hot)
        return _whole(rows, kind)
    # Fewer than HOT_SHARE conversations are that long, whatever the input.
    ids = hot.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    keyed = rows.withColumn("key", key)
    short = keyed.join(F.broadcast(ids.select("key")), "key", "left_anti").drop("key")
    long = keyed.join(F.broadcast(ids.select("key")), "key").drop("conv_id")
    return _whole(short, kind).unionByName(_cut(long, ids, kind))

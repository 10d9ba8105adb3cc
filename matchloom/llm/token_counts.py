"""Token counts that follow edits: a tree of sums over each document's pre-tokens, of which only the touched part is counted anew.

Leaves are stretches of pre-tokens that end at white space, where no token can cross, so that counts add up; a text without
white space is one leaf. A document's leaves are kept as a row: its text with the lengths and counts of its leaves, written as
a table that the next batch of edits reads (:func:`token_trees`, :func:`apply_edits`). An edit touches the leaves that it
overlaps, and a neighbour where the seam is not at white space; these are encoded again and sums are corrected up to the
root. All else stays as counted, over any number of batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import materialize, row_hash, ship
from .wordtokens import Words, library_words

#: Code points of a leaf, before it is extended to the next white space.
LEAF = 256

# White space in both the vocabulary's pattern and Python; other characters never end a leaf.
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")


@dataclass(frozen=True)
class Edit:
    """Replaces ``size`` code points from ``start`` on by ``text``. Places beyond the end count as the end."""

    start: int
    size: int
    text: str


class CountTree:
    """Leaves with their texts, lengths and token counts under a segment tree of sums of lengths and counts."""

    def __init__(self, words: Words, text: str, leaf: int = LEAF, sums: tuple[list[int], list[int]] | None = None):
        """Counts ``text``, or takes the lengths and counts of its leaves from ``sums``, as :attr:`sums` gives them."""
        self.words, self.leaf, self.encoded = words, leaf, 0
        if sums is None:
            self.leaves = self._cut(text)
        else:
            ends = [0, *accumulate(sums[0])]
            self.leaves = [(text[a:b], n) for a, b, n in zip(ends, ends[1:], sums[1])]
        self._build()

    def _count(self, part: str) -> int:
        self.encoded += len(part)
        return len(self.words.ids(part)) // 4

    def _cut(self, text: str) -> list[tuple[str, int]]:
        out, at = [], 0
        while at < len(text):
            m = _SPACE.search(text, min(len(text), at + self.leaf))
            end = m.end() if m else len(text)
            out.append((text[at:end], self._count(text[at:end])))
            at = end
        return out

    def _build(self) -> None:
        n = 1
        while n < len(self.leaves):
            n *= 2
        self.width = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (part, count) in enumerate(self.leaves):
            self.chars[n + i], self.tokens[n + i] = len(part), count
        for i in range(n - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.leaves)

    @property
    def sums(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of the leaves that hold text."""
        there = [(len(p), n) for p, n in self.leaves if p]
        return [a for a, _ in there], [n for _, n in there]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` and the place in it; the last leaf's end for the text's end."""
        if at >= self.chars[1]:
            last = max(0, len(self.leaves) - 1)
            return last, self.chars[self.width + last]
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    def apply(self, edit: Edit) -> None:
        if not self.leaves:
            self.leaves = self._cut(edit.text)
            return self._build()
        start = min(max(0, edit.start), self.chars[1])
        (a, x), (b, y) = self.find(start), self.find(min(self.chars[1], start + max(0, edit.size)))
        if x == 0 and a:  # the text before may now go on into the edit
            a, x = a - 1, len(self.leaves[a - 1][0])
        new = self.leaves[a][0][:x] + edit.text + self.leaves[b][0][y:]
        while b + 1 < len(self.leaves) and new and not _SPACE.match(new[-1]):  # the last chunk goes on in the next leaf
            b += 1
            new += self.leaves[b][0]
        parts, room = self._cut(new), b + 1 - a
        if len(parts) > room and len(new) <= 4 * self.leaf * room:  # counts add up, so leaves may be joined
            tail = parts[room - 1 :]
            parts[room - 1 :] = [("".join(p for p, _ in tail), sum(n for _, n in tail))]
        parts += [("", 0)] * (room - len(parts))
        self.leaves[a : b + 1] = parts
        if len(parts) > room:  # much new text: sums are added up anew, nothing is encoded again
            return self._build()
        level = set()
        for i, (part, count) in enumerate(parts, self.width + a):
            self.chars[i], self.tokens[i] = len(part), count
            level.add(i // 2)
        while level and 0 not in level:
            for i in level:
                self._sum(i)
            level = {i // 2 for i in level}


_NAMES = ["n_tokens", "n_tokens_after", "n_edits", "n_leaves", "n_chars_after", "n_chars_encoded"]


def token_trees(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, text, chars, tokens)`` per row of ``docs``: the text with the lengths and counts of its leaves.

    Null texts count as empty and stay null. Write it (or an outcome of :func:`apply_edits`) as a table to count later edits from it.
    """
    ship(docs.sparkSession)

    def run(batches):
        words = library_words(tokenizer)
        for batch in batches:
            sums = [CountTree(words, t or "", leaf).sums for t in batch.column(1).to_pylist()]
            cols = [batch.column(1), *(pa.array([x[i] for x in sums], pa.list_(pa.int32())) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "text", "chars", "tokens"])
        words.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, chars array<int>, tokens array<int>")


def edited_trees(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with each row's ``edits`` (doc_id, rh, edits: array of start, size, text, in order); ``rh`` is :func:`.cluster.row_hash` of the text."""
    named = edits.select(F.col("doc_id").alias("_d"), F.col("rh").alias("_r"), F.col("edits").alias("edits"))
    return trees.withColumn("_rh", row_hash()).join(named, F.expr("doc_id <=> _d AND _rh = _r"), "left").drop("_d", "_r", "_rh")


def apply_edits(rows: DataFrame, tokenizer: str, leaf: int = LEAF, keep_trees: bool = False) -> DataFrame:
    """Counts of each row (doc_id, text, chars, tokens, edits) before and after its edits, from its kept sums.

    Returns doc_id, n_tokens, n_tokens_after, n_edits, n_leaves, n_chars_after and n_chars_encoded (for the edits; the rest
    is never encoded again), and with ``keep_trees`` the row's new text, chars and tokens. Null texts count as empty; rows
    without edits keep their count. Null or repeated doc_ids don't matter: every row is counted by itself.
    """
    ship(rows.sparkSession)

    def run(batches):
        words = library_words(tokenizer)
        for batch in batches:
            out, kept = [], []
            for text, chars, tokens, edits in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                tree = CountTree(words, text or "", leaf, (chars or [], tokens or []))
                before = tree.total
                for e in edits or ():
                    tree.apply(Edit(e["start"], e["size"], e["text"]))
                sums = tree.sums
                out.append((before, tree.total, len(edits or ()), len(sums[0]), tree.chars[1], tree.encoded))
                if keep_trees:
                    kept.append((tree.text, *sums))
            cols = zip(*out) if out else [()] * len(_NAMES)
            more = zip(*kept) if kept else [()] * 3 * keep_trees
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols), *(pa.array(c, k) for c, k in zip(more, kinds))], ["doc_id", *_NAMES, *["text", "chars", "tokens"][: 3 * keep_trees]]
            )
        words.forget()

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in _NAMES) + (", text string, chars array<int>, tokens array<int>" if keep_trees else "")
    return rows.select(F.col("doc_id").cast("long"), "text", "chars", "tokens", "edits").mapInArrow(run, schema)


def counted_sample(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """:func:`sample_edits` counted from trees that are written once and read back.

    Null texts count as empty. An empty table gives no rows; columns besides doc_id and text are ignored, whatever their names.
    """
    return apply_edits(sample_edits(materialize(token_trees(docs, tokenizer, leaf), "trees")), tokenizer, leaf)


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits for each row: an insertion, a deletion and a replacement that swaps in other text of the row."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, size, text: F.struct(F.floor(at).cast("long").alias("start"), F.lit(size).cast("long").alias("size"), text.alias("text"))
    some = F.coalesce(F.substring("text", 1, 24), F.lit("text"))
    return docs.withColumn("edits", F.array(edit(n / 4, 0, F.lit("new words, inserted ")), edit(n / 2, 17, F.lit("")), edit(n * 3 / 4, 31, some)))

"""BPE encoding and decoding by a dynamic program over prefixes.

A BPE encoding of a string restricted to a prefix is the encoding of some prefix whose last token is
unique: among the vocabulary's tokens that end there, exactly one is compatible with the last token
of what is left of it. So one pass over the automaton's matches stores that token for every prefix, and
following the lengths back from the end gives the ids. Two tokens are compatible if encoding their
concatenation gives these two: undo merges on both sides of the seam, latest first, and see that no
merge across the seam would have come earlier.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import ship
from .wordtokens import SPECIALS, Words, byte_letters

#: Stands for the end of a word, in place of the vocabulary's suffix.
END = "\ue000"
#: Compatible pairs kept per worker.
KEPT_PAIRS = 1_000_000


class PrefixBpe(Words):
    """Exact ids of a merge table in which every token arises from one merge and encodes to itself."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.of_id = {i: inner(t) for t, i in model["vocab"].items() if t not in SPECIALS}
        id_of = {t: i for i, t in self.of_id.items()}
        # Rank in order of merging; what no merge makes comes first.
        self.rank: dict[int, int] = dict.fromkeys(self.of_id, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(model["merges"]):
            a, b = inner(a), inner(b)
            whole = id_of[a + b]
            if whole in self.halves:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.rank[whole], self.halves[whole], self.merged[id_of[a], id_of[b]] = k, (id_of[a], id_of[b]), whole
        self.automaton = ahocorasick.Automaton()
        for i, t in self.of_id.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        pair = left, right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Merges on either side are undone from the latest; ``bar`` is the time up to which the seam must hold."""
        rank, halves, bar = self.rank, self.halves, len(self.halves)
        while True:
            across = self.merged.get((left, right))
            if across is not None and rank[across] < bar:
                return False
            l, r = rank[left], rank[right]
            if l < 0 and r < 0:
                return True
            if l > r:
                # The merge across must come before the one that took the left token's end away.
                bar, left = l, halves[left][1]
            else:
                # The leftmost of equal merges is made first, so at the same time the seam still wins.
                bar, right = r + 1, halves[right][0]

    def encode_letters(self, letters: str) -> list[int]:
        word = letters + END
        n = len(word)
        last = [-1] * (n + 1)
        at = [0] * (n + 1)
        done = 0
        for end, (size, token) in self.automaton.iter(word):
            end += 1
            if done == end or end == n - 1:
                continue
            start = end - size
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                last[end], at[end], done = token, start, end
        out = []
        while n:
            out.append(last[n])
            n = at[n]
        return out[::-1]

    @property
    def spelled(self) -> list[bytes]:
        """What decoding writes for each id."""
        if not hasattr(self, "_spelled"):
            self._spelled = [(self.lib.id_to_token(i) or "").encode() for i in range(self.lib.get_vocab_size(True))]
        return self._spelled

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: the vocabulary names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def prefix_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, digests of ids and of the decoded text; with ``keep_ids`` both themselves.

    Null and empty texts give no tokens and an empty decoded text. doc_id may be null or repeated; there is
    one row out per row in, without a shuffle, and none for an empty table. Other columns of ``docs`` are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    more = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches):
        bpe = prefix_bpe(tokenizer)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = bpe.ids(text)
                back = bpe.decode(ids)
                row = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
                rows.append((*row, np.frombuffer(ids, "<u4").astype("i4"), back.decode()) if keep_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: 5 if keep_ids else 3]]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names[: 1 + len(cols)])
        bpe.forget()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")

"""Text to pre-tokens and ids for a lower-casing BPE vocabulary with word ends, in a Python worker.

Pre-tokens never cross white space, so ids are kept by white-space-delimited chunk: common chunks
are encoded once per worker. The two ways of encoding a pre-token are the library's own model
(:class:`LibraryWords`) and the dynamic program in :mod:`.bpe_dp`.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import regex

# Fixed values of the vocabulary's file format: its pattern of pre-tokens and its special tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIALS = ("<|startoftext|>", "<|endoftext|>")

#: Entries kept by chunk and by pre-token, and the longest text kept: bounds memory and changes no result.
KEPT, KEPT_SIZE = 200_000, 64

_PRETOKEN = regex.compile(PRETOKEN)
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")
#: Beyond these characters, Python and the library may disagree on case, classes or white space; the library then splits.
_UNUSUAL = re.compile("[^\\t\\n\\x0b\\x0c\\r -~\\xa1-\\xac\\xae-\\u024f\\u2010-\\u2027\\u20ac]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def as_letters(word: str) -> str:
    # Printable ASCII stands for itself.
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


class Kept:
    """The entries last seen, in two generations: the older one goes once the newer one is full."""

    def __init__(self, size: int = KEPT):
        self.size, self.new, self.old = size, {}, {}

    def find(self, key: str) -> bytes | None:
        """For what ``new`` doesn't have."""
        found = self.old.get(key)
        if found is not None:
            self.add(key, found)
        return found

    def add(self, key: str, value: bytes) -> None:
        if len(key) > KEPT_SIZE:
            return
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value


@cache
def library(path: str):
    """The tokenizers library's tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Words:
    """Encodes texts; ``encode_letters`` gives the ids of one pre-token in byte letters."""

    def __init__(self, path: str):
        self.lib = library(path)
        self.chunks, self.words = Kept(), Kept()
        self.special = {s: np.array([self.lib.token_to_id(s)], "<u4").tobytes() for s in SPECIALS}

    def forget(self) -> None:
        """Free what was kept: a Python worker outlives its task, and other tasks need the memory."""
        self.chunks, self.words = Kept(), Kept()

    def encode_letters(self, letters: str) -> list[int]:
        raise NotImplementedError

    def _word(self, word: str) -> bytes:
        """A pre-token's ids."""
        kept = self.words
        ids = kept.new.get(word)
        if ids is None and (ids := kept.find(word)) is None:
            made = self.encode_letters(as_letters(word))
            kept.add(word, ids := struct.pack(f"<{len(made)}I", *made))
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.find(chunk)
        if ids is None:
            plain = chunk.isascii() and chunk.isalpha()
            ids = self._word(chunk) if plain else b"".join(map(self._word, _PRETOKEN.findall(chunk)))
            self.chunks.add(chunk, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            text = self.lib.normalizer.normalize_str(text)
            if _UNUSUAL.search(text):
                words = (w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(text))
                return np.fromiter(chain.from_iterable(map(self.encode_letters, words)), "<u4").tobytes()
        else:
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        parts, kept, make = [], self.chunks, self._chunk
        for chunk in text.split():
            ids = kept.new.get(chunk)
            parts.append(make(chunk) if ids is None else ids)
        return b"".join(parts)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; b"" for null."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special.get(part) or self._plain(part) for part in _SPECIAL.split(text) if part)


class LibraryWords(Words):
    def encode_letters(self, letters: str) -> list[int]:
        return [t.id for t in self.lib.model.tokenize(letters)]


@cache
def library_words(path: str) -> LibraryWords:
    return LibraryWords(path)

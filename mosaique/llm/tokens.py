"""Encoders that give the tokenizers library's ids, with a bounded cache of fragments in each worker.

A text whose characters have settled classes is cut as the model's own pattern cuts it. Any other text is cut
only where no token can cross: in front of a space after a visible character, and around runs of white space.
Each fragment is encoded once by the library's model and remembered; a document's ids are the concatenation of
its fragments' ids.

`ByteBpe` is for byte-level models whose pattern keeps white space. `WordBpe` is for models that drop white
space and mark word ends; inside a word it also cuts between two byte symbols that stand side by side in
no token of the vocabulary (forced boundaries), and encodes those pieces independently.

Texts with special-token strings or rare white space, where fragments may not be independent, are handed
to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import regex

from mosaique.llm.common import SPACE

#: Fragments that a worker remembers (twice as many at most, about 100 MB), and the longest of them.
CACHE_ENTRIES = 300_000
CACHE_LENGTH = 120

_BYTE_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_WORD_CHUNK = re.compile(f"[^{SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this code point the classes of letters and digits are the same in every Unicode version in use.
_SETTLED = "Ͱ"


def _ranges(kinds: str) -> str:
    """The settled characters of some Unicode categories as ranges of a character class."""
    codes = [c for c in range(ord(_SETTLED)) if unicodedata.category(chr(c))[0] in kinds]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return "".join(f"{chr(b)}-{chr(e)}" for b, e in zip(starts, ends, strict=True))


_L, _N = _ranges("L"), _ranges("N")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: The models' patterns for settled texts without rare white space; letters, which nothing else begins with, come first.
_BYTE_PIECES = re.compile(f" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_WORD_PIECES = re.compile(f"[{_L}]+|{_ENDINGS}|[{_N}]|[^{SPACE}{_L}{_N}]+")
_UNSETTLED = re.compile(f"[^\x00-{chr(ord(_SETTLED) - 1)}]")
#: What lower-casing or composition could move out of the settled characters, or make depend on its neighbours.
_UNSETTLED_WORD = re.compile("[^\x00-\u017f]|[\u0130\x1c-\x1f\x85\xa0]")


def byte_symbols() -> dict[int, str]:
    """Byte -> printable symbol: printable Latin-1 stands for itself, the rest moves above 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    moved = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(moved)}


_SYMBOLS = byte_symbols()


def to_symbols(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_SYMBOLS)


class Cache(dict):
    """Fragment -> what `make` gives for it. When full, what was asked for since the last time stays within reach."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_LENGTH:
                return value
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _pack(ids: Iterable[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteBpe:
    """Ids of a byte-level BPE model as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Twice as many as for words in lower case: capitals and a leading space make fragments of their own.
        self.cache = Cache(self._chunk, 2 * CACHE_ENTRIES)

    def whole(self, text: str) -> bool:
        """Must the library see this text in one piece?"""
        return any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f") or (not text.isascii() and _ODD_SPACE.search(text) is not None)

    def encode_whole(self, text: str) -> bytes:
        return _pack(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        symbols = "Ġ" + piece[1:] if piece.isascii() and piece.isprintable() and piece.rfind(" ") == 0 else to_symbols(piece)
        return _pack([t.id for t in self.model.tokenize(symbols)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) >= _SETTLED:
            return self.encode_whole(chunk)
        if chunk[chunk[0] == " " :].isalpha():
            return self._piece(chunk)
        if chunk[-1] in ".,;:!?)" and chunk[chunk[0] == " " : -1].isalpha():
            return self.cache[chunk[:-1]] + self.cache[chunk[-1]]
        pieces = _PIECES.findall(chunk)
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.cache.__getitem__, pieces))

    @staticmethod
    def chunks(text: str) -> list[str]:
        return (_BYTE_PIECES if text.isascii() or not _UNSETTLED.search(text) else _BYTE_CHUNK).findall(text)

    def encode(self, text: str) -> bytes:
        if self.whole(text):
            return self.encode_whole(text)
        return b"".join(map(self.cache.__getitem__, self.chunks(text)))


class WordBpe:
    """Ids of a BPE model with word ends, with forced boundaries inside words."""

    END = "</w>"

    def __init__(self, path: str):
        from tokenizers.models import BPE

        self.library = _library(path)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        if spec["model"].get("end_of_word_suffix") != self.END or spec.get("decoder"):
            raise ValueError("this encoder is for models that end words with </w> and have no decoder")
        self.final_model, self.inner_model = self.library.model, BPE(vocab=vocab, merges=merges)
        self.joined = joined_pairs(vocab, self.END)
        self.inner = Cache(lambda piece: _pack([t.id for t in self.inner_model.tokenize(piece)]), CACHE_ENTRIES // 10)
        self.cache = Cache(self._chunk)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.library.id_to_token(k) for k in range(size)]
        self.decimals = [str(k) for k in range(size)]

    def fragments(self, word: str) -> list[str]:
        """The word's byte symbols, cut at every forced boundary."""
        if self.joined.issuperset(map(str.__add__, word, word[1:])):
            return [word]
        found, start = [], 0
        for at in range(1, len(word)):
            if word[at - 1 : at + 1] not in self.joined:
                found.append(word[start:at])
                start = at
        return [*found, word[start:]]

    def _word(self, word: str) -> bytes:
        *inner, last = self.fragments(word)
        end = _pack([t.id for t in self.final_model.tokenize(last)])
        return b"".join([*map(self.inner.__getitem__, inner), end]) if inner else end

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < _SETTLED:
            low = chunk.lower()
            if low.isalpha():
                return self.cache[low] if low != chunk else self._word(low if low.isascii() else to_symbols(low))
            if chunk[-1] in ".,;:!?)" and low[:-1].isalpha():
                return self.cache[low[:-1]] + self.cache[chunk[-1]]
        if any(s in chunk for s in self.special):
            return _pack(self.library.encode(chunk, add_special_tokens=False).ids)
        clean = self.library.normalizer.normalize_str(chunk)
        return b"".join(self._word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean))

    def encode(self, text: str) -> bytes:
        if _UNSETTLED_WORD.search(text) or any(s in text for s in self.special):
            pieces = _WORD_CHUNK.findall(text)
        else:
            pieces = _WORD_PIECES.findall(text.lower())
        return b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


def joined_pairs(vocab: Iterable[str], end: str) -> set[str]:
    """The pairs of symbols that stand side by side in some token; a pair outside this set is a certain cut."""
    pairs: set[str] = set()
    for token in vocab:
        body = token.removesuffix(end) or token
        pairs.update(body[k : k + 2] for k in range(len(body) - 1))
    return pairs


@lru_cache(maxsize=4)
def encoder(kind: type, path: str):
    """One encoder per worker process and vocabulary file."""
    return kind(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine (each worker looks it up for itself)."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)

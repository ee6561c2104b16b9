"""Token ids of whole texts, by a tokenizer file of the tokenizers library.

A file with the fixed normaliser and split below splits a text into pieces (none
has white space) and encodes each piece on its own, so each distinct word is given to the
library's model once per worker and its ids are kept, up to a bounded number. Texts with
characters outside a plain set (where the library's normaliser could act in ways
other than lower-casing), or with the opening of a special token, go to the
library whole, as do all texts if the file has other rules. Both ways give the
library's ids.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 2

#: The rules of files whose words can be kept: lower case, white space dropped, this split, bytes as letters.
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_SPLITS = ["Split", "ByteLevel"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split, for the plain set of characters below.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭį]+|[0-9]|[^\sa-z0-9ßà-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭį]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-į]*")
#: Words kept in a worker, twice: those met lately, and those before them.
KEPT_WORDS = 200_000


def letters_of_bytes() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Ids of words without white space, as bytes; what is missing is encoded, and the oldest half goes when it is full."""

    def __init__(self, model, kept: int) -> None:
        super().__init__()
        self._model, self._kept, self._older = model, kept, {}
        self._letters = letters_of_bytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            pieces = _PIECES.findall(word)
            ids = self._piece(word) if pieces == [word] else b"".join([self[p] if p != word else self._piece(p) for p in pieces])
        if len(self) >= self._kept:
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self._letters[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(shown)])


def splits_words(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer has the rules under which words can be encoded on their own."""
    rules = json.loads(tokenizer.to_str())
    kinds = lambda part, name: [x.get("type") for x in (rules.get(part) or {}).get(name, [])]
    if kinds("normalizer", "normalizers") != _NORMALISERS or kinds("pre_tokenizer", "pretokenizers") != _SPLITS:
        return False
    split, letters = rules["pre_tokenizer"]["pretokenizers"]
    plain = all(rules.get(x) is None for x in ("post_processor", "truncation", "padding")) and all("<|" in t["content"] for t in rules["added_tokens"])
    return plain and split["pattern"] == {"Regex": _SPLIT} and (split["behavior"], split["invert"]) == ("Removed", True) and not letters["add_prefix_space"] and not letters["use_regex"]


class TextEncoder:
    """Encodes texts to little-endian 32-bit ids."""

    def __init__(self, path: str | None = None, kept: int = KEPT_WORDS) -> None:
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self._by_words = splits_words(self.tokenizer)
        self._words = _Words(self.tokenizer.model, kept)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as bytes."""
        if not self._by_words or _PLAIN.fullmatch(text) is None or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._words.__getitem__, text.lower().split()))


def first_free_id(path: str | None = None) -> int:
    """The least id above all of a tokenizer file's, added tokens included."""
    return max(Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY)).get_vocab(with_added_tokens=True).values()) + 1


_encoders: dict[str | None, TextEncoder] = {}


def encoder(path: str | None = None) -> TextEncoder:
    """The worker's encoder of this file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]

"""Byte-level BPE with the tokenizers library, remembering the ids of text pieces.

The library splits a text into pieces by a fixed pattern and merges bytes inside each piece only, so a piece
has the same ids wherever it stands. Texts of common characters are split here by an equal pattern, and the
library encodes each new piece once; texts with other characters, or with the name of a special token, go to the
library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

# The letters, numbers and white space below U+0250.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_RARE = re.compile("[^\x00-ɏ]")


# The library's names of the 256 bytes; printable Latin-1 bytes stand for themselves.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


class _Pieces(dict):
    """Ids of pieces as bytes; a piece not held is taken from the older generation, or merged by the library."""

    def __init__(self, merge, older: dict[str, bytes]):
        super().__init__()
        self.merge, self.older = merge, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():
                named = piece.replace(" ", _BYTE_NAMES[32])
            else:
                named = piece.encode().decode("latin-1").translate(_BYTE_NAMES)
            ids = array("I", [t.id for t in self.merge(named)]).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """encode() gives a text's ids, as the library's own call gives them, as little-endian unsigned 32-bit integers.

    remember: pieces after which a new generation begins; two are held, of about 150 bytes a piece.
    """

    def __init__(self, path: str, remember: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.known = _Pieces(self.library.model.tokenize, {})
        self.remember = remember

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not text.isascii() and _RARE.search(text) or self.special and self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > self.remember:
            self.known = _Pieces(self.known.merge, dict(self.known))
        return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

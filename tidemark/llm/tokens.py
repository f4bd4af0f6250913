"""Token ids of whole texts by a public byte-level BPE vocabulary, with bounded caches per worker.

The text is cut into the pieces of the vocabulary's own pre-tokeniser; the ids of each piece are
looked up in a cache and computed by the library's BPE model on a miss. Texts with characters outside
the Latin range below or with the special token go to the library whole. The ids are those of the
library in every case (tests compare both).
"""

from __future__ import annotations

import array
import re
import sys

# Pre-tokeniser of the vocabulary over Latin letters, and the letters and numbers of that range.
# Fixed values.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0"
_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_OUTSIDE = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\x85\xa0-ɏ]")

_CACHED = 600_000  # entries of a cache; it starts anew when full
_CACHED_CHARS = 48  # longer pieces are not kept


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level BPE writes each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= _CACHED_CHARS:
            if len(self) >= _CACHED:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.pieces = _Cache(self._piece)

    @staticmethod
    def _pack(ids) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(written)])

    def encode(self, text: str) -> bytes:
        if _OUTSIDE.search(text) or any(s in text for s in self.special):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; kept between tasks as long as the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

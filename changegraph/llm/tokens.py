"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

Byte-level BPE never merges across a single space or line break between two visible
characters, so ids of a text are the ids of its pieces, one after the other. Each Python
worker keeps the ids of the pieces that it has met, in a table of bounded size; a text
with other white space is first cut by an equivalent pattern.
"""

from __future__ import annotations

import os
import re
from array import array

from changegraph.llm.text import caches

#: Pieces that a worker remembers, with and without a leading space (each some 200 bytes), before it starts anew, unless told otherwise.
REMEMBERED = 300_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Every white space character but space and line feed, after str.isspace.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]


class _Ids(dict):
    """Ids of pieces, found on first use. Letters and a mark after them are separate tokens."""

    def __init__(self, tokenizer, lead: str, remembered: int):
        super().__init__()
        self.tokenizer, self.lead, self.remembered = tokenizer, lead, remembered
        self.marks = {c: self._encoded(c) for c in ".,;:!?"}

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        mark = self.marks.get(piece[-1:])
        if mark is not None and piece[:-1].isalpha():
            return self[piece[:-1]] + mark
        if len(self) >= self.remembered:
            self.clear()
        ids = self._encoded(self.lead + piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.first, self.later = _Ids(self.tokenizer, "", remembered), _Ids(self.tokenizer, " ", remembered)
        self.line = self.first["\n"]

    def _spaced(self, pieces: list[str]) -> bytes:
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = (
            not text[0].isspace() and not text[-1].isspace()
            and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
            and not any(c in text for c in _OTHER)
        )
        if not plain:
            return self._spaced(_SAFE.split(text))
        return self.line.join([self._spaced(x.split(" ")) for x in text.split("\n")])


_encoders: dict[tuple[str, int], Encoder] = {}
caches.append(_encoders)


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder of a tokenizer file that remembers so many pieces."""
    key = (path, remembered)
    if key not in _encoders:
        _encoders[key] = Encoder(path, remembered)
    return _encoders[key]

"""Token ids of whole texts, word by word.

The vocabulary's splitting drops white space and never looks across it, so a text's ids are the ids of its white-space
separated words, one after another. Words repeat; each is encoded once and then looked up as ready bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import unicodedata
from array import array

import pyarrow as pa

from boardframe.llm import hashing

#: Words that a worker remembers before it drops those not asked for of late.
MEMORY = 200_000
#: Marks that end a word and form one piece of their own after letters.
MARKS = ".,;:!?|%$&*#"

#: How the vocabulary writes each byte: printable ones as themselves, the others from U+0100 on, in order.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: chr(b) for b in PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


class Words(dict):
    """Ids of white-space separated words. When full, it keeps what was asked for since it was half as full."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenize = self.tokenizer.model.tokenize
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMORY:
            self.before = dict(self)
            self.clear()
            self.parts.clear()
        found = self[word] = self.before.get(word) or self._encode(word.decode())
        return found

    def _encode(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if not stem.isalpha():
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        found = self.parts.get(stem) or self._part(stem)
        return found if len(stem) == len(word) else found + self._part(word[len(stem) :])

    def _part(self, part: str) -> bytes:
        """Plain letters go to the merges at once; all else goes through the vocabulary's own normalising and splitting."""
        if part in self.parts:
            return self.parts[part]
        plain = ""
        if part.isalpha() and max(part) < "\u0250":
            plain = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
        if plain.isalpha():
            shown = plain if plain.isascii() else "".join(map(SHOWN.__getitem__, plain.encode()))
            found = array("I", [token.id for token in self.tokenize(shown)]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        self.parts[part] = found
        return found


class Encoder:
    """``encode(text)`` gives its ids as little-endian unsigned 32-bit integers, ``end_id`` last; null is empty."""

    def __init__(self, vocabulary: str, end_id: int):
        self.words, self.end = Words(vocabulary), array("I", [end_id]).tobytes()

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        # The vocabulary lower-cases all but its special tokens, after marks have joined their letters: texts with such marks stay as they are here.
        plain = raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()
        return b"".join(map(self.words.__getitem__, plain.split())) + self.end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, end_id: int) -> Encoder:
    """One for each worker process, kept between tasks."""
    if (vocabulary, end_id) not in _ENCODERS:
        _ENCODERS[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _ENCODERS[vocabulary, end_id]


def forget() -> None:
    """Frees what this worker remembers and gives unused memory back to the system; scans that encode nothing call it, as workers outlive
    their tasks."""
    _ENCODERS.clear()
    hashing.POWERS.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call on other systems
        ctypes.CDLL("libc.so.6").malloc_trim(0)

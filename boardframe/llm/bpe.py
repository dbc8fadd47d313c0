"""Byte-pair encoding by a last token for every prefix, and decoding.

The encoding of a piece's prefix ends with exactly one token, and what stands before that token is the encoding of the shorter
prefix. So a piece is read once by the suffix automaton of all tokens, which gives the tokens that end at each place; of
these the one counts that stays apart from the last token of the prefix before it. Following the last tokens back gives the
ids. Two tokens stay apart if no merge across their border comes before the merges that make them; that is seen by undoing
these merges, the latest first.

A text's pieces come from the tokenizer file's own normalising and splitting. Words repeat, so a task remembers their ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch
from boardframe.llm.suffix_automaton import Automaton
from boardframe.llm.tokens import MARKS, SHOWN

#: Bytes of texts after which a task hands on what it has.
FLUSH = 4 << 20
#: Normalising and splitting under which a text's pieces are those of its parts between ASCII white space, and plain letters one piece.
BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
NEVER = 1 << 62
#: Latin letters end here; all below that Python calls letters are letters to the tokenizer's splitting too.
LATIN = "\u0250"
#: Words, pieces, and pairs of tokens that a worker remembers, and the symbols of a piece that are remembered as its beginning.
MEMORY, HEAD = 300_000, 4


class Recent(dict):
    """Remembers values. When it is full, it keeps those asked for since it was half as full."""

    def __init__(self):
        self.before: dict = {}

    def seen(self, key):
        """A value that was remembered before the last clearing, now remembered again; None if there is none."""
        found = self.before.get(key)
        return found if found is None else self.add(key, found)

    def add(self, key, value):
        if len(self) >= MEMORY:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """Tokens of a vocabulary and the merges that make them; ``encode`` gives the ids of a piece of symbols."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-pair encodings are known")
        self.ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        size = max(self.ids.values()) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.made: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            x, y, to = self.ids[a], self.ids[b], self.ids[a + b]
            if self.rank[to] >= 0 or max(self.rank[x], self.rank[y]) >= rank:
                raise ValueError("every token must have one merge, later than those of its parts")
            self.left[to], self.right[to], self.rank[to], self.made[x, y] = x, y, rank, rank
        # A token's symbols are those of its parts; tokens that no text leads to are left out.
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in self.ids.values() if self.rank[i] < 0}
        alone = set(self.symbols)
        for i in sorted((i for i in self.ids.values() if self.rank[i] >= 0), key=self.rank.__getitem__):
            x, y = self.left[i], self.right[i]
            self.symbols[i] = self.symbols[x] + self.symbols[y]
            if x in alone and y in alone and self.apart(x, y, self.rank[i]):
                alone.add(i)
        tokens = sorted(alone)
        self.length = {i: len(self.symbols[i]) for i in tokens}
        automaton = Automaton(self.symbols[i] for i in tokens)
        self.goes, self.back, self.size = automaton.goes, automaton.back, automaton.size
        self.token = [-1] * len(self.size)
        for i, state in zip(tokens, automaton.whole, strict=True):
            self.token[state] = i
        # Of each state the nearest one behind it that is a token.
        self.shorter = [0] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            behind = self.back[state]
            self.shorter[state] = behind if self.token[behind] >= 0 else self.shorter[behind]
        self.known, self.heads = Recent(), Recent()

    def apart(self, x: int, y: int, until: int = NEVER) -> bool:
        """Whether the symbols of ``x`` and ``y`` side by side become ``x`` and ``y``, and stay so before the merge ``until``."""
        rank, made = self.rank, self.made
        while made.get((x, y), NEVER) >= until:
            if rank[x] > rank[y]:
                # Its own merge, further left, goes before an equal one across the border.
                until, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                until, y = rank[y] + 1, self.left[y]
            else:
                return True
        return False

    def encode(self, symbols: list[int]) -> list[int]:
        goes, back, size, token, shorter, length, known = self.goes, self.back, self.size, self.token, self.shorter, self.length, self.known
        last = [-1] * (len(symbols) + 1)
        at = held = done = 0
        head = tuple(symbols[:HEAD]) if len(symbols) > HEAD else None
        if found := head and (self.heads.get(head) or self.heads.seen(head)):
            last[: HEAD + 1], at, held = found
            done = HEAD
        for end, symbol in enumerate(symbols[done:], done + 1):
            while symbol not in goes[at]:
                at = back[at]
                held = size[at]
            at, held = goes[at][symbol], held + 1
            # The state is a token that ends here only if all of its longest stretch has been read.
            place = at if token[at] >= 0 and size[at] == held else shorter[at]
            while True:
                found = token[place]
                before = end - length[found]
                if before == 0:
                    break
                pair = last[before], found
                fits = known.get(pair)
                if fits is None:
                    fits = known.seen(pair)
                    if fits is None:
                        fits = known.add(pair, self.apart(*pair))
                if fits:
                    break
                place = shorter[place]
            last[end] = found
            if head and end == HEAD:
                self.heads.add(head, (last[: HEAD + 1], at, held))
        ids, end = [], len(symbols)
        while end:
            ids.append(last[end])
            end -= length[last[end]]
        return ids[::-1]


class Codec(Recent):
    """Ids of words as bytes."""

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as source:
            spec = json.load(source)
        added = spec.get("added_tokens") or []
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens must be taken as they are written")
        self.merges, self.tokenizer = Merges(spec["model"]), Tokenizer.from_file(vocabulary)
        self.by_words = (spec.get("normalizer"), spec.get("pre_tokenizer")) == BY_WORDS
        self.added = {x["content"]: x["id"] for x in added}
        # Of two that begin at one place the longer counts.
        self.cut = re.compile("|".join(f"({re.escape(x)})" for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.shown = {i: s.encode() for s, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in added}
        self.joined = spec.get("decoder") is None
        self.pieces = Recent()

    def __missing__(self, word: bytes) -> bytes:
        return self.seen(word) or self.add(word, self._word(word.decode()))

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if stem.isalpha() and max(stem) < LATIN and (stem.isascii() or unicodedata.is_normalized("NFC", stem)):
            # One piece of letters, each lower-cased by itself, and maybe one of marks.
            plain = stem.lower() if stem.isascii() else "".join(c.lower() for c in stem)
            if plain.isalpha():
                shown = plain if plain.isascii() else "".join(map(SHOWN.__getitem__, plain.encode()))
                return self._piece(shown) + (self._piece(word[len(stem) :]) if len(stem) < len(word) else b"")
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        if self.cut is None:
            return self._plain(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._plain(text[at : found.start()]), array("I", [self.added[found[0]]]).tobytes()]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        pieces = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else [text]
        return b"".join(map(self._piece, filter(None, pieces)))

    def _piece(self, shown: str) -> bytes:
        found = self.pieces.get(shown) or self.pieces.seen(shown)
        if found:
            return found
        ids, suffix = self.merges.ids, self.merges.suffix
        symbols = [*map(ids.__getitem__, shown[:-1]), ids[shown[-1] + suffix]]
        return self.pieces.add(shown, array("I", self.merges.encode(symbols)).tobytes())

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.encode().split())) if self.by_words else self._whole(text)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: without a decoder of its own, the tokens as they are written, joined by a space."""
        numbers = memoryview(ids).cast("I")
        if self.joined:
            return b" ".join([self.shown[i] for i in numbers])
        return self.tokenizer.decode(list(numbers), skip_special_tokens=False).encode()


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """One for each worker process, kept between tasks."""
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def _scan(docs: DataFrame, vocabulary: str, work, columns: dict[str, pa.DataType], kinds: str) -> DataFrame:
    """``work`` gives the columns' values of each second value of ``docs``, the first goes along."""
    schema = pa.schema([("doc_id", pa.int64()), *columns.items()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        out: list[list] = [[] for _ in schema]
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        for held in batches:
            for doc, value in zip(held.column(0), held.column(1), strict=True):
                made = work(own, value.as_py())
                for to, x in zip(out, (doc.as_py(), *made), strict=True):
                    to.append(x)
                size += len(made[0])
                if size > FLUSH:
                    yield batch()
                    out, size = [[] for _ in schema], 0
        if out[0]:
            yield batch()

    Scratch(docs.sparkSession, "bpe")  # bounds the rows of an Arrow batch
    return docs.mapInArrow(scan, f"doc_id long, {kinds}")


def encode(docs: DataFrame, vocabulary: str, *, decoded: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ids (little-endian unsigned 32-bit integers) and, if asked for, decoded: the text
    that these ids stand for.

    ``vocabulary`` is a tokenizer file with a byte-pair encoding, readable on every machine. Special tokens in a text are encoded as such, none
    is added. Null and empty texts have no ids; repeated rows each give a row, other columns are left out; a text is worked on whole."""

    def work(own: Codec, text: str | None) -> tuple:
        ids = own.encode(text)
        return (ids, own.decode(ids)) if decoded else (ids,)

    extra = {"decoded": pa.string()} if decoded else {}
    return _scan(docs.select(F.col("doc_id").cast("long"), "text"), vocabulary, work, {"ids": pa.binary()} | extra, "ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    return _scan(encoded.select(F.col("doc_id").cast("long"), "ids"), vocabulary, lambda own, ids: (own.decode(ids or b""),), {"text": pa.string()}, "text string")

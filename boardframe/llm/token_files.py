"""Token ids in files of fixed-width bit packing.

A file holds the documents of one range of doc_id, in ascending order. Little-endian throughout:

    4s magic "BFTK", u32 version, u32 bits of an id, u32 ids of a block, u64 documents, u64 ids
    i64[documents] doc_id, u8[documents] whether doc_id is null, u64[documents + 1] first id of each document
    u64[blocks + 1] byte offset of each block after this table
    blocks: id i of a block takes bits [i * bits, (i + 1) * bits), lowest first; blocks begin at bytes

Each block unpacks alone with a few numpy operations, so any document can be read without the rest.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch, shuffle_partitions
from boardframe.llm.tokens import encoder

HEAD = struct.Struct("<4sIIIQQ")
MAGIC, VERSION, BLOCK = b"BFTK", 1, 4096
#: Bytes of packed ids after which a task starts its next file.
FILE_BYTES = 8 << 20
#: Ids that are packed or unpacked at once; whole blocks.
AT_ONCE = 1 << 18


def width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` whole bytes; each byte gathers the ids that reach into it."""
    padded = np.zeros(-(-len(ids) // 8) * 8, np.uint32)
    padded[: len(ids)] = ids
    groups = np.ascontiguousarray(padded.reshape(-1, 8).T)
    out = np.zeros((bits, groups.shape[1]), np.uint8)
    for k in range(bits):
        for i in range(8 * k // bits, min(7, (8 * k + 7) // bits) + 1):
            shift = i * bits - 8 * k
            out[k] |= (groups[i] << np.uint32(shift) if shift >= 0 else groups[i] >> np.uint32(-shift)).astype(np.uint8)
    return out.T.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    padded = np.zeros(-(-count // 8) * bits, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    groups = np.ascontiguousarray(padded.reshape(-1, bits).T).astype(np.uint32)
    out = np.zeros((8, groups.shape[1]), np.uint32)
    for i in range(8):
        for k in range(i * bits // 8, (i * bits + bits - 1) // 8 + 1):
            shift = 8 * k - i * bits
            out[i] |= groups[k] << np.uint32(shift) if shift >= 0 else groups[k] >> np.uint32(-shift)
    return (out.T.reshape(-1)[:count] & np.uint32((1 << bits) - 1)).astype("<u4")


def to_file(doc_ids: list[int | None], ids: list[bytes], bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    flat = np.frombuffer(b"".join(ids), "<u4")
    packed = [pack(flat[i : i + AT_ONCE], bits) for i in range(0, len(flat), AT_ONCE)]
    # BLOCK is a multiple of 8, so every block begins at a byte.
    offsets = np.minimum(np.arange(-(-len(flat) // BLOCK) + 1) * (BLOCK * bits // 8), sum(map(len, packed))).astype("<u8")
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, VERSION, bits, BLOCK, len(doc_ids), len(flat))
    return b"".join([head, known.tobytes(), nulls.tobytes(), starts.tobytes(), offsets.tobytes(), *packed])


class TokenFile:
    """Reads the bytes of a file: ``ids(a, b)`` unpacks only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, docs, self.count = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs)
        at += 9 * docs + 8 * (docs + 1)
        n = -(-self.count // self.block)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at)
        self.data = memoryview(data)[at + 8 * (n + 1) :]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, a: int, b: int) -> np.ndarray:
        first, last = a // self.block, -(-b // self.block)
        held = unpack(self.data[int(self.offsets[first]) : int(self.offsets[last])], self.bits, min(last * self.block, self.count) - first * self.block)
        return held[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, ids: int = AT_ONCE) -> Iterator[tuple[int | None, np.ndarray]]:
        """All, in order, unpacking about ``ids`` of them at once."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids, "right")) - 1)
            a = int(self.starts[i])
            flat = self.ids(a, int(self.starts[j]))
            for k in range(i, j):
                yield None if self.nulls[k] else int(self.doc_ids[k]), flat[int(self.starts[k]) - a : int(self.starts[k + 1]) - a]
            i = j


def _put(uri: str, data: bytes) -> None:
    """Writes under another name and renames, so that a task that is run again or twice leaves one whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    folder, name = os.path.split(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(part := f"{folder}/.{name}-{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(part, path)


def _get(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        return source.read()


WRITTEN = pa.schema({"part": pa.int64(), "seq": pa.int64(), "name": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()})


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int, vocab_size: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the files into ``folder``, a place that all executors share.

    Files follow each other in ascending doc_id (null first; of equal doc_ids, by text); within one document nothing is cut.
    Null and empty texts have the end id alone. The result, a table beside the files, has a row for each file: name, place (its order),
    n_docs, n_ids, start (ids of all files before it). No documents: no files.
    """
    spark = docs.sparkSession
    bits = width(vocab_size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seq = TaskContext.get().partitionId(), encoder(vocabulary, end_id).encode, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{seq:06d}.bftk"
            _put(f"{folder}/{name}", to_file(keys, ids, bits))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "n_docs": [len(keys)], "n_ids": [size // 4]}, schema=WRITTEN)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encode(text.as_py())
                keys.append(key)
                ids.append(found)
                size += len(found)
                if size * bits >= file_bytes * 32:
                    yield flush()
                    keys, ids, size, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    table = Scratch(spark, "token-files")
    files = table.save(ordered.mapInArrow(write, "part long, seq long, name string, n_docs long, n_ids long"), "written")
    # Files of a task are counted in order within it, tasks by a row for each.
    tasks = files.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.count("*").alias("files"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids"), F.coalesce(F.sum("files").over(earlier), F.lit(0)).alias("files"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(own), F.lit(0))
    counted = files.withColumn("before", start).join(tasks, "part")
    return table.save(counted.select("name", (F.col("files") + F.col("seq")).alias("place"), "n_docs", "n_ids", (F.col("ids") + F.col("before")).alias("start")), "files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers). ``files`` are dealt
    among tasks, and each task reads those it is dealt."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for doc, ids in TokenFile(_get(f"{folder}/{name}")).documents():
                    for to, x in zip(out, (doc, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        to.append(x)
                    start += len(ids)
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), out, strict=True)), schema=pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]))

    dealt = files.select("name", "start").repartition(shuffle_partitions(files.sparkSession), "name")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, *, end_id: int, vocab_size: int) -> DataFrame:
    """Writes the files below the shared folder and reads them back."""
    folder = f"{Scratch(docs.sparkSession, 'tokens').path}/ids"
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id=end_id, vocab_size=vocab_size), folder)

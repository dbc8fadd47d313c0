"""Removal of repeated byte strings by sparse distributed prefix doubling.

A suffix array up to a threshold says which strings of that length start at several positions. Prefix doubling finds it by
sorting positions with pairs of ranks at growing offsets, and drops positions whose rank is unique. Most positions are
unique at a short offset, so ranks are only taken where they decide:

1. Offset ``GRAM``: every window of ``length`` bytes names one of its positions, the least hash of the ``GRAM`` bytes there,
   leftmost on ties. Equal windows name equal places. The rank of such an anchor is the hash of its bytes.
2. Spark sorts anchors by (rank at ``GRAM``, rank of all that windows around it can reach, position). An anchor whose first
   rank is unique is done, as are all windows that named it. One whose second rank is not the first of its kind has all
   its windows repeated. Only firsts among several second ranks remain.
3. Their windows are ranked at the full ``length``, past which nothing is asked: of equal ones all but the first are repeated.

Ranks are 64-bit hashes, which are equal where the strings are, so each sort is one shuffle and no position is ranked
whose anchor is unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.hashing import BASE, POWERS, between, mix, sums
from boardframe.llm.store import Scratch, shuffle_partitions
from boardframe.llm.tokens import forget

GRAM = 32
#: Anchors that a task ranks among themselves before they move.
CHUNK = 1_000_000
#: Contexts of one anchor's rank that a task holds at once; of more, windows are ranked by a shuffle of their own.
HELD = 2048
#: Bits of the table of documents whose texts move. Its size is fixed; a full one lets all move.
DOC_BITS = 24
#: Low bits of a sliding key that hold the position.
PLACE = 31


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both sides of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a text of ``length`` bytes at least: rank at GRAM, rank of the context, position, and how far before it the first and the last
    of the windows that name it begin (``low`` to ``high``)."""
    total, reach = sums(raw), length - GRAM
    n = len(raw)
    at = np.arange(n - GRAM + 1)
    grams = between(total, at, at + GRAM)
    place = np.uint64((1 << PLACE) - 1)
    least = sliding_least((grams & ~place) | at.astype(np.uint64), reach + 1)
    named = (least & place).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    ends = np.concatenate([starts[1:], [len(named)]]) - 1
    pos = named[starts]
    left, right = np.minimum(pos, reach), np.minimum(n - pos, length)
    context = between(total, pos - left, pos + right) + (left * 1_000_003 + right).astype(np.uint64) * np.uint64(BASE)
    return grams[pos], mix(context), pos, pos - ends, pos - starts


NAMES = ("rank", "context", "doc", "twin", "pos", "low", "high", "kind")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
SCHEMA = "rank long, context long, doc long, twin long, pos int, low int, high int, kind int"
#: kind: an anchor with its windows; a span of repeated bytes from pos to low; a first among several contexts.
ANCHOR, SPAN, FIRST = 0, 1, 2


def _table(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(columns, TYPES, strict=True)], names=list(NAMES))


def _spans(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of kind SPAN; those of a document that follow and touch each other become one."""
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (start[1:] > end[:-1]) | (start[1:] < start[:-1])])
        first = np.flatnonzero(new)
        doc, twin, start, end = doc[first], twin[first], start[first], np.maximum.reduceat(end, first)
    none = np.zeros(len(doc), np.int32)
    return _table(mix(doc.astype(np.uint64)), none.astype(np.int64), doc, twin, start.astype(np.int32), end.astype(np.int32), none, np.full(len(doc), SPAN, np.int32))


def _rank(length: int):
    """Documents (doc, twin, text) in order to anchors; of equal anchors in a chunk only the first moves on."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rank, context, doc, twin, pos, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first = np.unique(mix(rank + mix(context)), return_index=True)
        new = np.zeros(len(rank), bool)
        new[first] = True
        for a in range(0, len(first), 50_000):
            i = np.sort(first)[a : a + 50_000] if a else (first := np.sort(first))[:50_000]
            yield _table(rank[i], context[i], doc[i], twin[i], pos[i], low[i], high[i], np.full(len(i), ANCHOR, np.int32))
        old = ~new
        yield _spans(doc[old], twin[old], pos[old] - high[old], pos[old] - low[old] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, twin, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                if len(raw) < length:
                    continue
                rank, context, pos, low, high = anchors(raw, length)
                parts.append((rank, context, np.full(len(pos), doc), np.full(len(pos), twin), pos, low, high))
                held += len(pos)
                if held > CHUNK:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _rerank(length: int):
    """Rows sorted by rank, context and position. An anchor that repeats a context gives a span; of ranks with several contexts the
    first of each is kept; unique ranks are dropped. Only the last row of a batch is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)  # rank and context before this batch
        alone: tuple | None = None  # the only first of that rank so far
        for batch in batches:
            rank, context, doc, twin, pos, low, high, kind = (c.to_numpy() for c in batch.columns)
            own = kind == SPAN
            if own.any():
                yield batch.filter(pa.array(own))
            rank, context, doc, twin, pos, low, high = (x[~own] for x in (rank, context, doc, twin, pos, low, high))
            if not len(rank):
                continue
            new_rank = np.concatenate([[rank[0] != last[0]], rank[1:] != rank[:-1]])
            new = new_rank | np.concatenate([[context[0] != last[1]], context[1:] != context[:-1]])
            old = ~new
            yield _spans(doc[old], twin[old], pos[old] - high[old], pos[old] - low[old] + length)
            first = np.flatnonzero(new)
            group = np.cumsum(new_rank)[first]  # 0: the rank of the last batch
            count = np.bincount(group, minlength=1)
            known = rank[0] == last[0] and alone is None  # that rank has had several firsts
            several = count[group] > 1
            if count[0]:
                several[group == 0] = True  # one more than was held or sent before
            if count[0] and alone is not None:
                yield _table(*(np.array([x]) for x in alone))
            if count[0]:
                known = True
            kept = first[several]
            yield _table(rank[kept], context[kept], doc[kept], twin[kept], pos[kept], low[kept], high[kept], np.full(len(kept), FIRST, np.int32))
            if new_rank.any():
                end = group[-1] if len(group) else 0
                alone = None
                if count[end] == 1 and end:
                    i = first[group == end][0]
                    alone = (rank[i], context[i], doc[i], twin[i], pos[i], low[i], high[i], np.int32(FIRST))
            elif known:
                alone = None
            last = (rank[-1], context[-1])

    return run


def _contexts(length: int):
    """Documents with their undecided anchors to the bytes around these, or to the ranks of windows where many share an anchor's rank."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, twin, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for p in places:
                    a = p["pos"]
                    around = raw[max(0, a - reach) : a].rjust(reach, b"\0") + raw[a : a + length].ljust(length, b"\0")
                    out.append((p["rank"], doc, twin, a, p["low"], p["high"], around, p["many"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=["rank", "doc", "twin", "pos", "low", "high", "around", "many"])

    return run


def window_ranks(around: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, distance before the anchor, and rank of each window that begins ``low`` to ``high`` bytes before it; by row."""
    reach = length - GRAM
    total = sums(np.frombuffer(b"".join(around), np.uint8).reshape(len(around), reach + length))
    _, down = POWERS.get(reach + 1)
    far = np.arange(reach + 1)
    ranks = mix((total[:, reach - far + length] - total[:, reach - far]) * down[reach - far])
    row, at = np.nonzero((far >= low[:, None]) & (far <= high[:, None]))
    return row, at, ranks[row, at]


def _decide(length: int):
    """Contexts sorted by rank and position: of equal windows all but the first are spans. Ranks are whole in a round."""

    def settle(columns: list[np.ndarray], around: list[bytes]) -> pa.RecordBatch:
        doc, twin, pos, low, high = columns
        row, far, ranks = window_ranks(around, low, high, length)
        _, first = np.unique(ranks, return_index=True)
        old = np.ones(len(ranks), bool)
        old[first] = False
        i = row[old]
        start = (pos[i] - far[old])[::-1]  # a row's windows ascend then
        return _spans(doc[i][::-1], twin[i][::-1], start, start + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not len(rows):
                continue
            rank = rows["rank"].to_numpy()
            end = int(np.searchsorted(rank, rank[-1]))  # sorted: the last rank's rows wait
            if end:
                done = rows.slice(0, end)
                yield settle([done[c].to_numpy() for c in ("doc", "twin", "pos", "low", "high")], done["around"].to_pylist())
            held = rows.slice(end)
        if held is not None and len(held):
            yield settle([held[c].to_numpy() for c in ("doc", "twin", "pos", "low", "high")], held["around"].to_pylist())

    return run


def _explode(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            doc, twin, pos, low, high = (batch.column(k).to_numpy() for k in range(5))
            row, far, ranks = window_ranks(batch.column(5).to_pylist(), low, high, length)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(6).to_numpy()[row]), pa.array(ranks.view(np.int64)), pa.array(doc[row]), pa.array(twin[row]), pa.array((pos[row] - far).astype(np.int32))], names=["anchor", "rank", "doc", "twin", "pos"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bits(docs: DataFrame) -> np.ndarray:
    """A table of the documents (doc, twin); at most as many rows reach the driver as it has bits."""
    used = docs.select(F.shiftrightunsigned(F.xxhash64("doc", "twin"), 64 - DOC_BITS).cast("int").alias("bit")).distinct().toArrow()
    out = np.zeros(1 << DOC_BITS, bool)
    out[used["bit"].to_numpy()] = True
    return np.packbits(out)


def _has(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (7 - (bit & 7))) & 1 == 1


def dedup_strings(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Every byte is removed that lies in a string of ``length`` bytes which also starts earlier: in a row with a smaller
    doc_id (null first), or before in the same text; strings are judged on the input, and never reach into another text. Rows that share
    a doc_id are ordered by a hash of their texts; of rows repeated with their text one is the first. Null texts are empty;
    texts shorter than ``length`` keep all. spans lists the removed runs as (start, end).
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "suffix"), shuffle_partitions(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))

    ranked = rows.where(F.octet_length("text") >= length).sortWithinPartitions("doc", "twin").mapInArrow(_rank(length), SCHEMA)
    dealt = ranked.repartition(parts, "rank").sortWithinPartitions("rank", "context", "doc", "twin", "pos")
    found = scratch.save(dealt.mapInArrow(_rerank(length), SCHEMA), "found")

    first = found.where(F.col("kind") == FIRST)
    many = scratch.save(first.groupBy("rank").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("rank", F.lit(True).alias("many")), "many")
    places = first.join(many, "rank", "left").groupBy("doc", "twin").agg(F.collect_list(F.struct("rank", "pos", "low", "high", F.coalesce("many", F.lit(False)).alias("many"))).alias("places"))
    table = _bits(first)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(table, batch.column(3).to_numpy()))).select([0, 1, 2])

    bit = F.shiftrightunsigned(F.xxhash64("doc", "twin"), 64 - DOC_BITS).cast("int").alias("bit")
    some = rows.where(F.octet_length("text") >= length).select("doc", "twin", "text", bit).mapInArrow(among, "doc long, twin long, text string").dropDuplicates(["doc", "twin"])
    around = some.join(places, ["doc", "twin"]).select("doc", "twin", "text", "places").mapInArrow(_contexts(length), "rank long, doc long, twin long, pos int, low int, high int, around binary, many boolean")
    around = scratch.save(around, "around")
    order = ["rank", "doc", "twin", "pos"]
    decided = around.where("NOT many").drop("many").repartition(parts, "rank").sortWithinPartitions(*order).mapInArrow(_decide(length), SCHEMA)
    windows = around.where("many").select("doc", "twin", "pos", "low", "high", "around", "rank").mapInArrow(_explode(length), "anchor long, rank long, doc long, twin long, pos int")
    windows = scratch.save(windows, "windows")
    # Equal windows have equal anchors: both hashes must agree.
    least = windows.groupBy("anchor", "rank").agg(F.min(F.struct("doc", "twin", "pos")).alias("least"))
    later = windows.join(least, ["anchor", "rank"]).where(F.struct("doc", "twin", "pos") != F.col("least"))
    spans = found.where(F.col("kind") == SPAN).select("doc", "twin", "pos", F.col("low").alias("end"))
    spans = spans.union(decided.select("doc", "twin", "pos", "low")).union(later.select("doc", "twin", "pos", F.col("pos") + length))
    spans = scratch.save(spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("pos", "end")).alias("spans")), "spans")
    touched = _bits(spans)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py().encode() for x in batch.column(2)]
            keep = _has(touched, batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([x if k else None for x, k in zip(raw, keep, strict=True)], pa.binary())], names=["doc", "twin", "n_bytes", "whole", "raw"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, size, whole, raw, found, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = [(0, size)] if again and size >= length else merged([(x["pos"], x["end"]) for x in found or []])
                if runs:
                    edges = [0, *(x for run in runs for x in run), size]
                    kept = hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).hexdigest() if runs != [(0, size)] else hashlib.sha256().hexdigest()
                out.append((None if doc == -(1 << 63) else doc, size, sum(b - a for a, b in runs), len(runs), kept if runs else whole, [{"start": a, "end": b} for a, b in runs]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    whole = rows.select("doc", "twin", "text", bit).mapInArrow(digest, "doc long, twin long, n_bytes long, whole string, raw binary")
    # Rows that repeat both doc_id and text: all but one repeat the first as a whole.
    again = F.expr("row_number() OVER (PARTITION BY doc, twin ORDER BY n_bytes) > 1")
    joined = whole.join(spans, ["doc", "twin"], "left").withColumn("again", again)
    return joined.select("doc", "n_bytes", "whole", "raw", "spans", "again").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")

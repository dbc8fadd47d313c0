"""Hierarchical multi-length packing: tiers of context sizes, each filled from the tiers below it.

A text's ids are cut into whole windows of the largest tier; what is left goes to the smallest tier that holds it. The
largest tier is packed first: a window opens with its longest piece, its gap takes whole pieces of shorter tiers, longest
first, and only where none fits is one cut to close it. So every window is exactly full. What a task has left at its end
becomes full windows of ever smaller tiers and less than one smallest window of pieces; those of many tasks are
packed together, and only there a sequence is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch
from boardframe.llm.tokens import encoder

TIERS = (512, 1024, 2048, 4096)
#: Ids that a task holds back, so that gaps find pieces that fit.
HELD = 400_000
#: Tasks whose remainders are packed together.
MERGED = 512

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset", "window")
#: A piece: doc_id, start, doc_tokens, ids as bytes.
Piece = tuple[int, int, int, bytes]


class Packer:
    """``add`` documents, ``rows()`` gives what is packed, ``rest()`` what is left as pieces below the smallest tier's size."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.queues, self.sums, self.seq = tiers, [deque() for _ in tiers], [0] * len(tiers), 0
        self.out: list[tuple] = []

    @property
    def held(self) -> int:
        return sum(self.sums)

    def _route(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        tier = bisect_left(self.tiers, size)
        self.queues[tier].append(piece)
        self.sums[tier] += size

    def _take(self, tier: int) -> Piece:
        piece = self.queues[tier].popleft()
        self.sums[tier] -= len(piece[3]) // 4
        return piece

    def add(self, doc: int, ids: bytes) -> None:
        total, top = len(ids) // 4, self.tiers[-1]
        whole = total - total % top
        for a in range(0, whole, top):
            self._emit([(doc, a, total, ids[4 * a : 4 * (a + top)])], top)
        if whole < total:
            self._route((doc, whole, total, ids[4 * whole :]))

    def _emit(self, pieces: list[Piece], window: int) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.seq, at, window))
            at += len(ids) // 4
        self.seq += 1

    def _fill(self, tier: int) -> None:
        """One full window of a tier; the queues up to it must hold enough."""
        window = gap = self.tiers[tier]
        pieces = []
        while gap:
            fits = next((k for k in range(tier, -1, -1) if self.queues[k] and len(self.queues[k][0][3]) // 4 <= gap), None)
            piece = self._take(next(k for k in range(tier + 1) if self.queues[k]) if fits is None else fits)
            if fits is None:
                doc, start, total, ids = piece
                piece = (doc, start, total, ids[: 4 * gap])
                self._route((doc, start + gap, total, ids[4 * gap :]))
            pieces.append(piece)
            gap -= len(piece[3]) // 4
        self._emit(pieces, window)

    def pack(self, keep: int) -> None:
        """Down to about ``keep`` ids: a window of each tier that has a piece, from the largest down, again and again."""
        while self.held > max(keep, self.tiers[-1]):
            for tier in range(len(self.tiers) - 1, -1, -1):
                if self.queues[tier] and sum(self.sums[: tier + 1]) >= self.tiers[tier]:
                    self._fill(tier)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def rest(self) -> list[Piece]:
        while self.held >= self.tiers[0]:
            tier = max(k for k, w in enumerate(self.tiers) if w <= self.held)
            for k in range(tier + 1, len(self.tiers)):  # longer pieces are cut to this tier's size
                while self.queues[k]:
                    doc, start, total, ids = self._take(k)
                    w = 4 * self.tiers[tier]
                    for a in range(0, len(ids), w):
                        self._route((doc, start + a // 4, total, ids[a : a + w]))
            self._fill(tier)
        return [x for q in self.queues for x in q]


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=list(names))


def pack_documents(docs: DataFrame, vocabulary: str, *, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 19) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, window, padding, step_group.

    ``tiers`` are ascending powers of two. Null and empty texts have the end id alone; repeated rows are packed each. A
    sequence's capacity is ``window``; ``padding`` is what it lacks: 0 but for the sequences of the tasks' remainders, each less than one window of
    the smallest tier, which are packed whole, those of ``MERGED`` tasks together. Texts are encoded where they are read. step_group numbers training steps: the full sequences of one tier in groups of ``step_tokens`` ids, so
    that every step but the last of a tier has as many ids and one shape; padded sequences form steps of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset", "window", "part")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, packer = TaskContext.get().partitionId(), encoder(vocabulary, end_id).encode, Packer(tiers)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, encode(text.as_py()))
                if packer.held > HELD:
                    packer.pack(HELD // 2)
            if rows := packer.rows():
                yield _batch([(*r, part) for r in rows], names)
        rest = [(doc, start, len(ids) // 4, zlib.crc32(ids), total, -1, 0, 0, part) for doc, start, total, ids in packer.rest()]
        if rows := [*((*r, part) for r in packer.rows()), *rest]:
            yield _batch(rows, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole pieces one after another; a piece that does not fit opens the next sequence."""
        group, seq, at = None, 0, 0
        for batch in batches:
            rows = []
            for *own, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part // MERGED != group:
                    group, seq, at = part // MERGED, 0, 0
                elif at + own[2] > tiers[-1]:
                    seq, at = seq + 1, 0
                rows.append((*own[:5], seq, at, 0, -1 - group))
                at += own[2]
            yield _batch(rows, names)

    schema = ", ".join(f"{c} long" for c in names)
    packed = scratch.save(docs.select("doc_id", "text").mapInArrow(pack, schema), "packed")
    left = packed.where("window = 0").withColumn("group", F.expr(f"part div {MERGED}"))
    left = left.repartition("group").sortWithinPartitions("group", "part", F.col("doc_id").asc_nulls_first(), "start").select(*names)
    merged = scratch.save(left.mapInArrow(merge, schema), "merged")
    both = packed.where("window > 0").unionByName(merged)

    # A row for each task and tier: where its sequences begin among all, and among those of its tier. Merged remainders come last.
    counts = both.groupBy("part", "window").agg(F.countDistinct("seq").alias("n"))
    place = [F.col("part") < 0, F.abs("part")]
    before = lambda line: F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy(*place)).alias("base"))
    bases = counts.select("part", "window", before(Window.partitionBy("window").orderBy(*place)).alias("tier_base")).join(starts, "part")
    sequences = both.groupBy("part", "window", "seq").agg(F.sum("length").alias("filled"))
    ranked = sequences.withColumn("rank", F.expr("row_number() OVER (PARTITION BY part, window ORDER BY seq) - 1")).join(bases, ["part", "window"])
    capacity = F.when(F.col("window") > 0, F.col("window")).when(F.expr("filled & (filled - 1)") == 0, F.col("filled")).otherwise(tiers[-1])
    sequence = ranked.select("part", "seq", (F.col("base") + F.col("seq")).alias("sequence_id"), capacity.alias("capacity"), (capacity - F.col("filled")).alias("padding"), F.concat_ws("-", F.col("window").cast("string"), F.floor((F.col("tier_base") + F.col("rank")) * capacity / step_tokens).cast("long").cast("string")).alias("step_group"))
    return both.join(sequence, ["part", "seq"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("capacity").alias("window"), "padding", "step_group")

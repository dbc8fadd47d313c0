"""Exact Jaccard join of shingle sets that skips by relations between sets.

Texts become sets of hashed word shingles; equal sets are one node. In a global order that puts frequent shingles last, two sets that
are similar enough share one of their first shingles, so only those are indexed. Index lists are kept in blocks of sets of similar
size; each knows its least position and largest size, and is skipped whole if not even these leave room for the overlap asked for.

What remains is answered through similar sets. A set is compared with the headers of its lists' blocks, and joins the cluster of the
nearest header it is linked to. Distances obey the triangle inequality, so two clusters, and all pairs between them, are skipped if their
headers are farther apart than both radii and a link; within a list a cluster is one entry. Components of what is left are small groups
of sets that are told by their differences from one header: two sets' differences tell their overlap, pairs are counted in blocks and
never become rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardframe.llm.components import connected_components
from boardframe.llm.hashing import runs, word_hashes
from boardframe.llm.store import Scratch, marked, shuffle_partitions
from boardframe.llm.tokens import forget

#: Bits of a shingle's slot, by which its sets are counted; parts of all slots; and shingles that a task packs at once.
SLOT_BITS, BLOCK_BITS, PACKED = 34, 10, 750_000
#: Frequent slots are those of 2**LEAST sets or more. Tasks get to know FREQUENT of them at most, by a table of as many bits as named; where
#: there are more, a shingle must be in more sets to be one of them. Only speed depends on it, as lists of other shingles stay short.
LEAST, FREQUENT, TABLE_BITS = 2, 1 << 21, 25
#: Shingles for which a set's parities have 512 bits; larger sets have more.
PARITY_EACH = 400
#: Sets, and items of their differences, of a part of a component; any two parts are compared by one task at a time.
PART_SETS, PART_ITEMS = 256, 1 << 20
#: Cells of a table of sets and items that is multiplied at once.
CELLS = 1 << 22


def shingles(text: str | None, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words of a text; of all words, if they are fewer."""
    words = word_hashes(text)
    return runs(words, min(n, len(words))) if len(words) else words


def node_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def kept(size: int, percent: int) -> int:
    """First shingles of a set of which a linked set has one at least."""
    return size - -(-percent * size // 100) + 1


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of a set's shingles falls into each slot, as 64-bit words. Their number doubles with the size of the set;
    folding its halves onto each other gives that of fewer slots."""
    bits = 512 << max(0, (len(found) - 1) // PARITY_EACH).bit_length()
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd).view(np.int64)


FIRST = {"doc_id": pa.int64(), "twin": pa.int64(), "node": pa.binary(), "n": pa.int32(), "parity": pa.list_(pa.int64()), "block": pa.int32(), "slots": pa.binary()}
FIRST_SCHEMA = "doc_id long, twin long, node binary, n int, parity array<long>, block int, slots binary"


def _packed(held: list[np.ndarray]) -> pa.RecordBatch:
    """Slots of many sets and in how many of these each is: a row for each block, with sorted slots as gaps and counts up to 255."""
    slots, count = np.unique(np.concatenate(held), return_counts=True)
    edges = np.searchsorted(slots, np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64) << np.uint64(SLOT_BITS - BLOCK_BITS))
    used = np.flatnonzero(np.diff(edges))
    low = (slots & np.uint64((1 << (SLOT_BITS - BLOCK_BITS)) - 1)).astype(np.uint32)
    count = np.minimum(count, 255).astype(np.uint8)
    data = [zlib.compress(np.diff(low[edges[k] : edges[k + 1]], prepend=np.uint32(0)).tobytes() + count[edges[k] : edges[k + 1]].tobytes(), 1) for k in used]
    rows = {"block": pa.array(used.astype(np.int32)), "slots": pa.array(data, pa.binary())}
    return pa.RecordBatch.from_arrays([rows.get(c, pa.nulls(len(used), t)) for c, t in FIRST.items()], names=list(FIRST))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 5
    return np.cumsum(np.frombuffer(raw, np.uint32, n)), np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64)


def _first_pass(n: int):
    """Rows (doc_id, text, twin) to what is known of their sets, and to slots of the sets that this task has not had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            nodes, sizes, parities = [], [], []
            for text in batch.column(1):
                found = np.unique(shingles(text.as_py(), n))
                nodes.append(node_of(found) if len(found) else None)
                sizes.append(len(found))
                parities.append(parity(found))
                if nodes[-1] and nodes[-1] not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(nodes[-1])
                    held.append(found >> np.uint64(64 - SLOT_BITS))
                    size += len(found)
                    if size > PACKED:
                        yield _packed(held)
                        held, size = [], 0
            none = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(parities, pa.list_(pa.int64())), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=list(FIRST))
        if held:
            yield _packed(held)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, slots) sorted by block to the slots that several sets have, by the size of their number (its logarithm). A block's counts
    are summed as they come; it has a fixed number of slots."""
    names = ["size", "n", "slots"]

    def done(block: int, counts: np.ndarray | list) -> pa.RecordBatch:
        if isinstance(counts, list):
            slots, at = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
            total = np.bincount(at, np.concatenate([x for _, x in counts]))
        else:
            slots = np.flatnonzero(counts)
            total = counts[slots]
        several = total > 1
        slots, sizes = slots[several].astype(np.uint64) + (np.uint64(block) << np.uint64(SLOT_BITS - BLOCK_BITS)), np.log2(total[several]).astype(np.int32)
        found = np.unique(sizes)
        # Tasks know a slot by its first bits alone.
        first = [np.unique(slots[sizes == k] >> np.uint64(SLOT_BITS - TABLE_BITS)).astype(np.uint32) for k in found]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([len(x) for x in first], pa.int64()), pa.array([x.tobytes() for x in first], pa.binary())], names=names)

    forget()
    block, held, size = None, [], 0
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != block:
                if block is not None:
                    yield done(block, held)
                block, held, size = k, [], 0
            slots, counts = _unpacked(data)
            if isinstance(held, list):
                held.append((slots, counts))
                size += len(slots)
                if size > 1 << (SLOT_BITS - BLOCK_BITS - 2):
                    dense = np.zeros(1 << (SLOT_BITS - BLOCK_BITS), np.int64)
                    for at, x in held:
                        dense[at] += x
                    held = dense
            else:
                held[slots] += counts
    if block is not None:
        yield done(block, held)


def frequent(first: DataFrame, scratch: Scratch) -> np.ndarray:
    """A table of the slots that most sets have, by their first bits: how frequent each is, 0 for all others. The driver sees a few numbers, then
    FREQUENT slots at most."""
    rows = first.where("block IS NOT NULL").select("block", "slots")
    rows = rows.repartition(shuffle_partitions(first.sparkSession), "block").sortWithinPartitions("block")
    counts = scratch.save(rows.mapInArrow(_counted, "size int, n long, slots binary"), "counts")
    out, total, least = np.zeros(1 << TABLE_BITS, np.uint8), 0, None
    for r in sorted(counts.groupBy("size").agg(F.sum("n").alias("n")).collect(), reverse=True):
        if r["size"] < LEAST or total + r["n"] > FREQUENT:
            break
        total, least = total + r["n"], r["size"]
    if least is not None:
        for r in counts.where(F.col("size") >= least).toArrow().to_pylist():
            at = np.frombuffer(r["slots"], np.uint32)
            out[at] = np.maximum(out[at], r["size"])
    return out


def _entries(n: int, percent: int, table):
    """Index entries: each set's first shingles, frequent ones last, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[bytes] = set()
        for batch in batches:
            nodes: list[bytes] = []
            parts: list[tuple] = []
            for text in batch.column(0):
                found = np.unique(shingles(text.as_py(), n))
                if not len(found) or (node := node_of(found)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                k = kept(len(found), percent)
                often = table.value[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[:k]  # of equally frequent ones the smaller first
                parts.append((found[order], np.full(k, len(nodes)), np.full(k, len(found), np.int32), np.arange(k, dtype=np.int32)))
                nodes.append(node)
            none = [np.zeros(0, t) for t in (np.uint64, np.int64, np.int32, np.int32)]
            token, at, size, pos = (np.concatenate(x) for x in zip(none, *parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(nodes, pa.binary()).take(pa.array(at)), pa.array(size), pa.array(pos)], names=["token", "node", "n", "pos"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [np.unique(shingles(text.as_py(), n)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node_of(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["doc_id", "node", "items"])

    return run


def _overlaps(held: list[tuple], one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets (name, size, whether of the first part, difference from a set that is the same for all): which are of the first part, of the
    other (or of the first again, if ``one``), and how many items their differences share."""
    first = np.array([x[2] for x in held], bool)
    length = np.array([len(x[3]) for x in held], np.int64)
    _, item, often = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True, return_counts=True)
    several = often > 1
    use = several[item]
    row, column = np.arange(len(held)).repeat(length)[use], (np.cumsum(several) - 1)[item[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a = np.flatnonzero(first)
    b = a if one else np.flatnonzero(~first)
    both, wide = np.zeros((len(a), len(b)), np.int64), max(1, CELLS // len(held))
    for low in range(0, int(several.sum()), wide):
        part = slice(*np.searchsorted(column, [low, low + wide]))
        table = np.zeros((len(held), min(wide, int(several.sum()) - low)), np.float32)
        table[row[part], column[part] - low] = 1
        both += (table[a] @ table[b].T).astype(np.int64)
    return a, b, both


def _linked(held: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of these sets, with how many of the other part it is linked (of its own part, if there is but one), and the first set
    that it reaches over links between these."""
    size, length = (np.array(x, np.int64) for x in zip(*((x[1], len(x[3])) for x in held), strict=True))
    one = all(x[2] for x in held)
    a, b, both = _overlaps(held, one)
    total = size[a][:, None] + size[b][None, :]
    same = (total - (length[a][:, None] + length[b][None, :] - 2 * both)) // 2
    link = 100 * same >= percent * (total - same)
    if one:
        np.fill_diagonal(link, False)
    count, label = np.zeros(len(held), np.int64), np.arange(len(held))
    if not one:
        count[b] = link.sum(0)
    count[a] = link.sum(1)
    while True:
        new = label.copy()
        np.minimum.at(new, a, np.where(link, label[b][None, :], len(held)).min(1, initial=len(held)))
        np.minimum.at(new, b, np.where(link, label[a][:, None], len(held)).min(0, initial=len(held)))
        new = new[new]
        if (new == label).all():
            return count, label
        label = new


def _compared(percent: int):
    """Rows sorted by group and two of its parts (low, high) to the links between sets of these: how many, and one that is reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, held = None, []

        def done() -> pa.RecordBatch:
            count, label = _linked(held, percent)
            some = np.flatnonzero(count)
            names = pa.array([x[0] for x in held], pa.binary())
            return pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(count[some]), names.take(pa.array(label[some]))], names=["node", "n_links", "reached"])

        for batch in batches:
            *keys, parts, nodes, sizes = (c.to_pylist() for c in batch.columns[:6])
            items = batch.column(6)
            edges = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
            values = items.flatten().to_numpy()
            for i, now in enumerate(zip(*keys, strict=True)):
                if now != key:
                    if held:
                        yield done()
                    key, held = now, []
                held.append((nodes[i], sizes[i], parts[i] == now[1], values[edges[i] : edges[i + 1]]))
        if held:
            yield done()

    return run


def _far(sum_: Column, apart: Column) -> Column:
    """Jaccard distance of two sets, from the sum of their sizes and how many items only one of them has."""
    return 2 * apart / (sum_ + apart)


def _is_link(percent: int) -> Column:
    return 100 * (F.col("sum") - F.col("apart")) >= percent * (F.col("sum") + F.col("apart"))


class _Sets:
    """The distinct sets: node, half (a number that stands for it among candidates), class_id, n, parity. Their items are read again from one
    text of each where they are needed."""

    def __init__(self, docs: DataFrame, words: int, table: DataFrame, percent: int, scratch: Scratch):
        self.docs, self.words, self.table, self.percent, self.scratch = docs, words, table, percent, scratch

    def items(self, nodes: DataFrame, tag: str) -> DataFrame:
        """node, items for each of ``nodes``, of the text that its class is named by, and so once, but for repeated rows."""
        ids = self.scratch.save(self.table.join(nodes, "node", "left_semi").select("node", "class_id"), tag)
        texts = marked(self.docs, ids.select(F.col("class_id").alias("doc_id"))).select("doc_id", "text")
        sets = texts.mapInArrow(_sets(self.words), "doc_id long, node binary, items array<long>")
        # No key of the join, so that its rows stay where joins on nodes find them.
        own = F.xxhash64("doc_id").bitwiseXOR(F.xxhash64("class_id")) == 0
        return sets.join(ids, "node").where(own).select("node", "items")

    def within(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Of ``pairs`` (a, b: halves, reach) those at a distance of ``reach`` at most: a, b (nodes), sum and apart. Parities tell most unlike
        sets without reading them."""
        a, b = (self.table.select(F.col("half").alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").withColumn("sum", F.col("n_a") + F.col("n_b"))
        most = F.when(F.col("reach") < 1, F.floor(F.col("reach") * F.col("sum") / (2 - F.col("reach")) + 1e-9)).otherwise(F.col("sum"))
        p, q = (_folded(F.col(x), F.size(y)) for x, y in (("p_a", "p_b"), ("p_b", "p_a")))
        least = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = both.withColumn("most", most).where(least <= F.col("most")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "sum", "most")
        near = self.scratch.save(near, f"{tag}-near")
        items = self.items(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), f"{tag}-nodes")
        both = near.join(items.toDF("a", "i_a"), "a").join(items.toDF("b", "i_b"), "b")
        both = both.select("a", "b", "sum", "most", (F.col("sum") - 2 * F.size(F.array_intersect("i_a", "i_b"))).cast("int").alias("apart"))
        return self.scratch.save(both.where("apart <= most").select("a", "b", "sum", "apart").distinct(), tag)

    def compared(self, members: DataFrame) -> DataFrame:
        """node, n_links, reached: all links within each group of ``members`` (node, group), a group being named by one of its sets. A set is
        told by its difference from that one, so that two sets' differences tell their overlap; pairs are counted in blocks."""
        save = self.scratch.save
        sets = save(self.items(members.select("node"), "members").join(members, "node").dropDuplicates(["node"]), "grouped")
        heads = save(sets.where("node = group").select("group", F.col("items").alias("head")), "heads")
        apart = F.concat(F.array_except("items", "head"), F.array_except("head", "items"))
        sets = save(sets.join(heads, "group").select("group", "node", F.size("items").alias("n"), apart.alias("apart")), "apart")
        self.scratch.drop("grouped")
        parts = sets.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum(F.size("apart")) / PART_ITEMS)).cast("int").alias("parts"))
        parts = save(parts, "parts")  # a table of its own, so that the join may split a large group
        own = sets.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node", F.lit(-1)), "parts").cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = own.select("group", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "n", "apart")
        key = ["group", "low", "high"]
        own = own.repartition(shuffle_partitions(self.docs.sparkSession), *key).sortWithinPartitions(*key)
        return save(own.mapInArrow(_compared(self.percent), "node binary, n_links long, reached binary"), "compared")


def _folded(own: Column, size: Column) -> Column:
    """Parities as of ``size`` words at most, where that is half of them or less: sets that can be linked have twice as many at most."""
    half = (F.size(own) / 2).cast("int")
    folded = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(own) > size, folded).otherwise(own)


def _index(texts: DataFrame, words: int, percent: int, table, scratch: Scratch) -> DataFrame:
    """Entries (token, band, half, n, pos) of the lists that hold two sets at least. Sets that can be linked are in the same or in
    neighbouring bands of sizes."""
    index = texts.mapInArrow(_entries(words, percent, table), "token long, node binary, n int, pos int")
    index = scratch.save(index.select("token", F.xxhash64("node").alias("half"), "n", "pos"), "index")
    lists = index.groupBy("token").agg(F.min("half").alias("low"), F.max("half").alias("high")).where("low <> high").select("token")
    lists = scratch.save(lists, "lists")
    band = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    entries = scratch.save(index.join(lists, "token", "left_semi").distinct().withColumn("band", band), "entries")
    scratch.drop("index")
    return entries


def _headed(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of each entry with the headers of its list's blocks of its own and the next sizes. The set with the least position heads a
    block: it has the fewest shingles that others lack, so a group of similar sets has few headers, and each is compared with few."""
    lead = F.struct("pos", "half", "n")
    blocks = entries.groupBy("token", "band").agg(F.min(lead).alias("head"), F.min("pos").alias("low_pos"), F.max("n").alias("high_n"))
    blocks = blocks.select("token", F.col("head.half").alias("other"), F.col("head.n").alias("other_n"), F.col("head.pos").alias("other_pos"), "low_pos", "high_n", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    x, y = F.col("n"), F.col("other_n")
    room = F.least(x - F.col("pos"), F.col("high_n") - F.col("low_pos")) >= F.ceil(percent * x / 100)
    fits = (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.least(x - F.col("pos"), y - F.col("other_pos")) >= _alpha(x, y, percent))
    probed = entries.join(blocks, ["token", "band"]).where(room & fits & (F.col("half") != F.col("other")))
    return probed.select(F.least("half", "other").alias("a"), F.greatest("half", "other").alias("b")).distinct()


def _clusters(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, head, radius: each linked set with the nearest header it is linked to, and the largest distance from that header. Headers are
    linked to no set that has more links; a set that is linked to no header heads itself."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    ends = scratch.save(ends.select(F.struct(-F.col("links"), F.xxhash64("node"), "node").alias("place"), "node"), "places")
    both = links.join(ends.toDF("pa", "a"), "a").join(ends.toDF("pb", "b"), "b")
    down = both.select(F.greatest("pa", "pb")["node"].alias("node"), F.least("pa", "pb")["node"].alias("head"), _far(F.col("sum"), F.col("apart")).alias("far"))
    down = scratch.save(down, "down")
    heads = down.select("head").distinct().join(down.select(F.col("node").alias("head")), "head", "left_anti")
    near = down.join(heads, "head").groupBy("node").agg(F.min(F.struct("far", "head")).alias("near"))
    own = scratch.save(ends.select("node").join(near, "node", "left").select("node", F.coalesce("near.head", "node").alias("head"), F.coalesce("near.far", F.lit(0.0)).alias("far")), "clusters")
    return scratch.save(own.join(own.groupBy("head").agg(F.max("far").alias("radius")), "head").select("node", "head", "radius"), "labels")


def _blocks_apart(entries: DataFrame, clusters: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b, reach: pairs of clusters, by their heads' halves, that stand in one list where sizes and places leave room for a link, and how far apart
    heads may be for that: sets of two clusters can only be linked if their heads are not farther than both radii and a link."""
    labels = clusters.select(F.xxhash64("node").alias("half"), F.xxhash64("head").alias("head"), "radius")
    named = entries.join(labels, "half", "left").select("token", "band", "n", "pos", F.coalesce("head", "half").alias("head"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    blocks = named.groupBy("token", "band", "head").agg(F.min("pos").alias("pos"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("radius").alias("radius"))
    blocks = scratch.save(blocks, "blocks")
    several = blocks.groupBy("token").agg(F.min("head").alias("x"), F.max("head").alias("y")).where("x <> y").select("token")
    open_ = scratch.save(blocks.join(scratch.save(several, "several"), "token", "left_semi"), "open")
    x, y = (open_.select("token", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("head", "pos", "low", "high", "radius"))) for k in "xy")
    x = x.withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("next"))
    fits = (100 * F.col("high_x") >= percent * F.col("low_y")) & (100 * F.col("high_y") >= percent * F.col("low_x"))
    room = F.least(F.col("high_x") - F.col("pos_x"), F.col("high_y") - F.col("pos_y")) >= _alpha(F.col("low_x"), F.col("low_y"), percent)
    once = F.when(F.col("next") == 0, F.col("head_x") < F.col("head_y")).otherwise(F.col("head_x") != F.col("head_y"))
    reach = F.col("radius_x") + F.col("radius_y") + (1 - percent / 100 + 1e-9)
    return x.join(y, ["token", "band"]).where(fits & room & once).select(F.least("head_x", "head_y").alias("a"), F.greatest("head_x", "head_y").alias("b"), reach.alias("reach")).distinct()


def _alpha(x: Column, y: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes that links them."""
    return F.ceil(percent * (x + y) / (100 + percent))


def similar(docs: DataFrame, *, words: int = 5, percent: int = 80, count: bool = True) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, twin (xxhash64 of the text), n_shingles, component_id, class_id and, if
    ``count``, n_links.

    A text's set has its distinct runs of ``words`` words (ASCII white space between them, A-Z lower-cased), or all its words
    as one if they are fewer. Sets are linked when 100 * intersection >= ``percent`` * union. component_id is the smallest
    doc_id that can be reached over links, class_id the smallest with an equal set (null doc_ids come last). Null, empty and
    blank texts have no set and are alone. Repeated rows get one row each. n_links is how many other sets a text's set is
    linked to, over all of them.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    first = scratch.save(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(_first_pass(words), FIRST_SCHEMA), "first")
    rows = first.where("n IS NOT NULL").select("doc_id", "twin", "node", "n")
    table = first.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    table = scratch.save(table.withColumn("half", F.xxhash64("node")), "table")
    sets = _Sets(docs, words, table, percent, scratch)
    often = docs.sparkSession.sparkContext.broadcast(frequent(first, scratch))
    entries = _index(docs.select("text"), words, percent, often, scratch)

    links = sets.within(_headed(entries, percent).withColumn("reach", F.lit(1 - percent / 100 + 1e-9)), "near").where(_is_link(percent))
    clusters = _clusters(links, scratch)
    apart = sets.within(_blocks_apart(entries, clusters, percent, scratch), "heads")

    ends = apart.select(F.col("a").alias("node")).union(apart.select("b")).distinct().join(clusters, "node", "left_anti")
    own = scratch.save(clusters.select("node", "head").union(ends.select("node", "node")), "own")
    certain = scratch.save(_renamed(links.union(apart.where(_is_link(percent))), own), "certain")
    own = _joined(own, connected_components(certain, scratch, "sure"), scratch, "sure")
    # Groups are components over all pairs of clusters that may have a link.
    open_ = scratch.save(_renamed(apart.where(~_is_link(percent)), own), "open")
    unsettled = bool(open_.take(1))
    groups = own
    if unsettled:
        wide = connected_components(open_, scratch, "wide")
        groups = _joined(own, wide, scratch, "wide")
    if count or unsettled:
        some = groups if count else groups.join(groups.join(wide.select("node"), "node", "left_semi").select("name").distinct(), "name", "left_semi")
        compared = sets.compared(some.select("node", F.col("name").alias("group")))
    if unsettled:
        more = scratch.save(_renamed(compared.select(F.col("node").alias("a"), F.col("reached").alias("b")), own), "more")
        own = _joined(own, connected_components(more, scratch, "more"), scratch, "more")

    named = table.select("node", "class_id").join(own, "node", "left").withColumn("name", F.coalesce("name", "node"))
    low = named.groupBy("name").agg(F.min("class_id").alias("component_id"))
    named = named.join(low, "name")
    out = [F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")]
    if count:
        named = named.join(compared.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")
        out.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = rows.where("node IS NULL").select("doc_id", "twin", F.col("n").cast("long"), "doc_id", "doc_id", *([F.lit(0).cast("long")] if count else []))
    return rows.where("node IS NOT NULL").join(named.drop("name"), "node").select("doc_id", "twin", *out).union(alone)


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """a, b: ``pairs`` by the second column of ``names``; those whose ends have different names, each once."""
    for x, y in ("ab", "ba"):
        pairs = pairs.join(names.toDF(x, "name"), x).select(F.col("name").alias(x), y)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(names: DataFrame, components: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, name: a name gives way to its component's."""
    names = names.toDF("node", "old")
    found = names.join(components.select(F.col("node").alias("old"), "component"), "old", "left")
    return scratch.save(found.select("node", F.coalesce("component", "old").alias("name")), f"names-{tag}")

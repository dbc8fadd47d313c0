"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, units and names turn into typed placeholders, all else into lower case without marks.
Windows of template words are hash-joined between documents and benchmark items; where the same place of an item keeps
standing for the same value, the windows of one alignment agree, and a question with other numbers or names is caught too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.hashing import ODD, SPACE, between, bounds, mix, runs, sums
from boardframe.llm.store import Scratch
from boardframe.llm.tokens import forget

#: Bits of the table of window hashes that goes to every task: its size is fixed, a full one only lets more windows pass.
FILTER_BITS = 22
#: Consecutive words that a document and an item share at most without being held together, however long the item is.
RUN_WORDS = 13
# Words that name units.
UNITS = frozenset("mm cm m km mg g kg t ml l s ms min h hz khz mhz kb mb gb tb v w kw inch inches foot feet yard yards mile miles ounce ounces pound pounds second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degrees".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-z]{1,3})?")
MARKS = "\"'`.,;:!?()[]{}<>*_#%&$|~"
#: A word that ends so, or has marks only, ends a sentence.
ENDS = ".!?:|"

IS_MARK, IS_END, IS_DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (MARKS.encode(), ENDS.encode(), b"0123456789"))


def _hash(text: str) -> np.uint64:
    raw = np.frombuffer(text.encode(), np.uint8)
    return between(sums(raw), np.array([0]), np.array([len(raw)]))[0]


NUM, UNIT, NAME = (_hash(x) for x in ("<num>", "<unit>", "<name>"))
UNIT_HASHES = np.sort(np.array([_hash(x) for x in UNITS]))
UNIT_BITS = np.zeros(1 << 16, bool)
UNIT_BITS[(UNIT_HASHES >> np.uint64(48)).astype(np.int64)] = True


def canonical(word: str, opens: bool) -> str:
    """The template of a word; ``opens`` if it begins a sentence, where a capital letter tells nothing."""
    bare = word.strip(MARKS)
    low = bare.lower()
    if low in UNITS:
        return "<unit>"
    if NUMBER.fullmatch(low):
        return "<num>"
    return "<name>" if not opens and bare[:1] != low[:1] else low


def ends(word: str) -> bool:
    return word[-1] in ENDS or not word.strip(MARKS)


def _cores(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the same without the marks around them."""
    first, last = bounds(raw)
    solid = np.flatnonzero(~(IS_MARK | SPACE)[raw])
    a, b = np.searchsorted(solid, first), np.searchsorted(solid, last)
    if not len(solid):
        return first, last, first, first
    blank = a == b
    start, end = solid[np.minimum(a, len(solid) - 1)], solid[np.maximum(b - 1, 0)] + 1
    return first, last, np.where(blank, first, start), np.where(blank, first, end)


def templates(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the templates of a text's words, and which of them are placeholders; as ``canonical`` has them, for all at once."""
    return _forms(text)[:2]


def _forms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``templates``, and hashes of the words themselves, in lower case without marks."""
    own, low = np.frombuffer(text.encode(), np.uint8), np.frombuffer(text.lower().encode(), np.uint8)
    first, last, start, end = _cores(low)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    hashes = between(sums(low), start, end)
    words = hashes.copy()
    slots = np.zeros(len(hashes), bool)
    for i in np.flatnonzero(UNIT_BITS[(hashes >> np.uint64(48)).astype(np.int64)]):
        if UNIT_HASHES[min(np.searchsorted(UNIT_HASHES, hashes[i]), len(UNIT_HASHES) - 1)] == hashes[i] and end[i] > start[i]:
            hashes[i], slots[i] = UNIT, True
    digits = np.concatenate([[0], np.cumsum(IS_DIGIT[low])])
    for i in np.flatnonzero(digits[end] > digits[start]):
        if NUMBER.fullmatch(low[start[i] : end[i]].tobytes().decode()):
            hashes[i], slots[i] = NUM, True
    _, own_last, own_start, own_end = _cores(own)
    opens = np.ones(len(hashes), bool)
    opens[1:] = IS_END[own[own_last[:-1] - 1]] | (own_start[:-1] == own_end[:-1])
    # A capital letter is one that lower case writes otherwise: its first two bytes tell.
    own2, low2 = np.append(own, [0, 0]), np.append(low, [0, 0])
    wide = own2[own_start] >= 0xC0
    capital = (own2[own_start] != low2[start]) | wide & (own2[own_start + 1] != low2[start + 1])
    names = capital & ~opens & ~slots & (end > start)
    hashes[names] = NAME
    return hashes, slots | names, words


def windows(text: str, n: int, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Placeholder flags, hashes of words, and the windows of ``n`` words and of each of the ``short`` lengths: their length, hashes, and
    which are plain.

    A text of fewer than ``n`` words is one window. At least half the words of a plain window are no placeholders; in the hashes of the
    others the words count too."""
    hashes, slots, words = _forms(text)
    most = min(n, len(hashes))
    count, out = np.concatenate([[0], np.cumsum(slots)]), []
    for size in sorted({most, *(k for k in short if k < most)}) if most else []:
        found, plain = runs(hashes, size), 2 * (count[size:] - count[:-size]) <= size
        if not plain.all():
            found = np.where(plain, found, mix(found * np.uint64(ODD) + runs(words, size)))
        out.append((size, found, plain))
    return slots, words, out


NAMES = ["id", "twin", "pos", "n", "total", "every", "plain", "hash", "values"]
SCHEMA = "id long, twin long, pos int, n int, total int, every int, plain boolean, hash long, values array<long>"


def window_rows(rows: DataFrame, n: int, wanted: np.ndarray | None, short: tuple[int, ...] = ()) -> DataFrame:
    """A row for each window of ``rows`` (id, twin, text) that ``wanted``, a table of bits, lets pass; all without one. total and every: the
    plain windows of that length in the text, and all. values: a hash of each word that a placeholder stands for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out: list[tuple] = []
            for key, twin, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                slots, words, lengths = windows(text.as_py() or "", n, short)
                for size, found, plain in lengths:
                    ok = np.ones(len(found), bool) if wanted is None else wanted[(found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    total = int(plain.sum())
                    for i in np.flatnonzero(ok).tolist():
                        values = [int(w) if s else None for w, s in zip(words[i : i + size].view(np.int64), slots[i : i + size], strict=True)]
                        out.append((key, twin, i, size, total, len(found), bool(plain[i]), int(found[i].astype(np.int64)), values))
                    if len(out) > 20_000:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    return rows.mapInArrow(cut, SCHEMA)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, words: int = 8, coverage: float = 0.25, short: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, twin (xxhash64 of the text), contaminated, n_items, item_ids, covered.

    A document is contaminated by an item of ``benchmark`` (item_id, text) if windows of ``words`` template words that both
    have make up ``coverage`` of the item's windows at least, two of them at least unless the item has but one, or if they hold
    RUN_WORDS consecutive words of it. Windows that are mostly placeholders must have equal words, and count in a share of all windows;
    the share of the others is taken as well. Plain windows of an alignment in which one value of the item stands for several in the
    document, or several for one, do not count. Items shorter than a window must be in the document as a whole text, or anywhere if
    ``short``. Null and empty texts match nothing; an
    empty benchmark leaves all documents clean. Rows that share a doc_id are judged each by its own text.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.save(window_rows(benchmark.select(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("twin"), "text"), words, None), "items")
    bits = np.zeros(1 << FILTER_BITS, bool)
    # At most as many rows as the table has bits.
    used = items.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("bit")).distinct().toArrow()
    bits[used["bit"].to_numpy()] = True

    # As many lengths as there are below that of a window.
    lengths = tuple(r["n"] for r in items.where(F.col("n") < words).select("n").distinct().collect()) if short else ()
    found = scratch.save(window_rows(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("twin"), "text"), words, bits, lengths), "found").alias("d")
    pairs = found.join(items.alias("b"), F.expr("d.hash = b.hash AND d.n = b.n AND d.plain = b.plain")).select(
        F.col("d.id").alias("doc_id"), F.col("d.twin").alias("twin"), F.col("b.id").alias("item_id"), F.col("b.pos").alias("place"), (F.col("d.pos") - F.col("b.pos")).alias("shift"), F.col("b.total").alias("total"), F.col("b.every").alias("every"), F.col("b.plain").alias("plain"), F.arrays_zip(F.col("b.values").alias("item"), F.col("d.values").alias("doc")).alias("slots")
    )
    pairs = scratch.save(pairs.distinct(), "pairs")
    one = ["doc_id", "twin", "item_id"]
    keys = [*one, "shift"]
    values = pairs.where("plain").select(*keys, F.explode(F.filter("slots", lambda s: s["item"].isNotNull())).alias("slot")).select(*keys, "slot.item", "slot.doc").distinct()
    unlike = values.groupBy(*keys, "item").agg(F.count("*").alias("n")).union(values.groupBy(*keys, "doc").agg(F.count("*").alias("n"))).where("n > 1").select(*keys).distinct()
    plain = pairs.where("plain")
    agreed = plain.join(unlike, [plain[k].eqNullSafe(unlike[k]) for k in keys], "left_anti").union(pairs.where("NOT plain"))
    agreed = scratch.save(agreed.select(*keys, "place", "total", "every", "plain").distinct(), "agreed")
    hits = agreed.groupBy(*one).agg(F.countDistinct(F.when(F.col("plain"), F.col("place"))).alias("places"), F.countDistinct("place").alias("all_places"), F.first("total").alias("total"), F.first("every").alias("every"))
    # Places in a row are counted where a run of them would begin.
    row = max(2, RUN_WORDS - words + 1)
    begins = agreed.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(row - 1)), lambda k: F.col("place") - k)).alias("begin"))
    long_ = begins.groupBy(*keys, "begin").agg(F.count("*").alias("n")).where(F.col("n") == row).select(*(F.col(c).alias(f"_{c}") for c in one), F.lit(True).alias("run")).distinct()
    hits = hits.join(long_, [hits[c].eqNullSafe(long_[f"_{c}"]) for c in one], "left")
    share = {"plain_share": F.coalesce(F.try_divide("places", "total"), F.lit(0.0)), "share": F.col("all_places") / F.col("every")}
    enough = (F.col("plain_share") >= coverage) & ((F.col("places") > 1) | (F.col("total") == 1) & (F.col("places") == 1)) | (F.col("share") >= coverage) & ((F.col("all_places") > 1) | (F.col("every") == 1))
    hits = hits.withColumns(share).where(enough | F.col("run").isNotNull()).withColumn("covered", F.greatest("plain_share", "share"))
    marked = hits.groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("covered").alias("covered"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("twin"))
    same = rows["doc_id"].eqNullSafe(marked["_id"]) & (rows["twin"] == marked["_twin"])
    return rows.join(marked, same, "left").select("doc_id", "twin", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))

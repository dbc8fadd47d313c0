"""Periodic runs of words, by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words long, that no neighbouring word
extends. A text is cut into factors, each the longest stretch that also begins earlier, which a suffix automaton finds. A run
whose last word lies in a factor either begins at or before the factor, and is found by Main's comparisons around that
place, or lies behind its first word, and is then a copy of a run of the factor's earlier occurrence. So each run is compared
once, and the work grows with the words.

Only stretches that may hold runs are factorised: every word of a run belongs to a group of ``k`` words that the run repeats.
Documents never share anything, so Spark scans them in parallel and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm import hashing
from boardframe.llm.store import Scratch
from boardframe.llm.suffix_automaton import Automaton
from boardframe.llm.tokens import forget

#: Bytes of texts after which a task hands on what it has.
FLUSH = 4 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

Run = tuple[int, int, int]


def factors(words: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """Begin, end, and the begin of the first occurrence of each factor; -1 for a word that did not occur before."""
    automaton = Automaton([words])
    goes, ends = automaton.goes, automaton.ends
    begin, n = 0, len(words)
    while begin < n:
        at, i = 0, begin
        while i < n and ends[to := goes[at][words[i]]] < i:
            at, i = to, i + 1
        yield (begin, i, ends[at] - (i - begin) + 1) if i > begin else (begin, i + 1, -1)
        begin = max(i, begin + 1)


def _agree(pattern: Sequence[int], text: Sequence[int]) -> list[int]:
    """How many words each place of ``text`` has in common with the beginning of ``pattern``."""
    both = [*pattern, -1, *text]
    found, low, high = [0] * len(both), 0, 0
    for i in range(1, len(both)):
        same = min(found[i - low], high - i) if i < high else 0
        while i + same < len(both) and both[same] == both[i + same]:
            same += 1
        found[i] = same
        if i + same > high:
            low, high = i, i + same
    return found[len(pattern) + 1 :]


def _crossing(words: Sequence[int], before: int, at: int, end: int, times: int, least: int) -> list[Run]:
    """Runs that begin at ``at`` or before it and end behind it, but not behind ``end``: (begin, end, period). ``before`` is where the
    factor before the one from ``at`` to ``end`` begins.

    Such a run's second period begins behind ``before``: else what follows there would have occurred earlier, up to the run's end, and the
    factor before would be longer. So ``times - 1`` periods fit between ``before`` and ``end``, which bounds the period and the begin."""
    most = (end - before - 1) // (times - 1)
    if most < 1:
        return []
    low, high = max(0, before - most), min(len(words), end + 1)
    left, right = words[low:at], words[at:high]
    turned = left[::-1]
    found: dict[tuple[int, int], int] = {}

    def keep(begin: int, stop: int, period: int) -> None:
        if at < stop <= end and stop - begin >= max(least, times * period):
            found.setdefault((begin, stop), period)  # periods come in ascending order, and the least one counts

    # One period or more on the left: words before ``at`` against those a period before, words from it on against those too.
    reach = min(most, at - low)
    ahead = _agree(right, words[at - reach : high])
    behind = _agree(turned, turned)
    # Less than a period on the left: the same around the word one period behind ``at``.
    ahead_in = _agree(right, right)
    last = min(most, len(right) - 1)
    behind_in = _agree(turned, words[max(low, at - most) : at + last][::-1])
    for period in range(1, most + 1):
        if period <= reach:
            back = behind[period] if period < len(behind) else 0
            keep(at - period - back, at + ahead[reach - period], period)
        if period <= last and (back := behind_in[last - period]) < period:
            keep(at - back, at + period + ahead_in[period], period)
    return [(begin, stop, period) for (begin, stop), period in found.items()]


def runs(words: list[int], times: int, least: int) -> list[Run]:
    """All runs of a stretch: (begin, end, period), by begin, then period."""
    found: list[tuple[int, int, int]] = []  # begin, period, end
    before, n = 0, len(words)
    for begin, end, source in factors(words):
        for a, b, period in _crossing(words, before, begin, end, times, least):
            insort(found, (a, period, b))
        before = begin
        if source < 0:
            continue
        # What is copied may lie in the source again, where the factor overlaps it; it then comes later in the order.
        shift, stop, i = begin - source, source + end - begin, bisect_right(found, (source, n, n))
        while i < len(found) and found[i][0] < stop:
            a, period, b = found[i]
            copied = min(b, stop) + shift
            if copied - a - shift >= max(least, times * period) and (copied < end or end == n or words[end] != words[end - period]):
                insort(found, (a + shift, period, copied))
            i += 1
    return [(a, b, period) for a, period, b in found]


def group_size(times: int, least: int) -> int:
    """The most words k for which each k neighbours within a run occur twice in it: a run has 2 * period + k - 1 words or more."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 2))


def stretches(ids: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Where runs may lie: each word in a group of ``k`` neighbours that occurs twice in its stretch. Groups are compared by hashes; equal ones
    by chance only make a stretch longer."""
    todo, found = [(0, len(ids))], []
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        _, group, count = np.unique(hashing.runs(ids[a:b], k), return_inverse=True, return_counts=True)
        again = count[group] > 1
        if not again.any():
            continue
        edge = np.zeros(b - a + 1, np.int64)
        edge[: len(again)] += again
        edge[k : k + len(again)] -= again
        inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        cut = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        if len(cut) == 1 and cut[0, 1] - cut[0, 0] == b - a:
            found.append((a, b))
        else:
            todo.extend((a + int(x), a + int(y)) for x, y in cut)
    return sorted(found)


def text_runs(words: Sequence[bytes], times: int, least: int) -> list[Run]:
    """Runs of a text's words as (start, length, period)."""
    known: dict[bytes, int] = {}
    ids = [known.setdefault(word, len(known)) for word in words]
    if len(ids) < least or len(known) == len(ids):
        return []
    parts = stretches(np.array(ids, np.uint64), group_size(times, least), least)
    return [(a + x, y - x, period) for a, b in parts for x, y, period in runs(ids[a:b], times, least)]


def collapse(words: Sequence[bytes], found: list[Run]) -> list[bytes]:
    """Words without those that a run holds behind its first period."""
    if not found:
        return list(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [word for word, n in zip(words, np.cumsum(gone), strict=False) if not n]


def repetitions(docs: DataFrame, *, times: int = 4, least: int = 6) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, runs (array of start, length, period in words, by start, then period), collapsed
    (the text's words without what runs repeat, joined by a space).

    Words are what ASCII white space separates, compared by their bytes. ``times`` periods (2 or more) and ``least`` words make a run.
    Null and empty texts, or ones of white space, have no runs and an empty text; repeated rows each give a row, and other columns
    are left out. A text is worked on whole; a long one takes some hundred bytes for each word of its periodic stretches."""
    if times < 2 or least < times:
        raise ValueError("a run has two periods or more, each of one word or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                found = text_runs(words, times, least)
                kept = b" ".join(collapse(words, found))
                for to, x in zip(out, (doc.as_py(), found, kept), strict=True):
                    to.append(x)
                size += len(kept)
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, FOUND, strict=True)], schema=FOUND)
                    out, size = ([], [], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, FOUND, strict=True)], schema=FOUND)
        forget()

    Scratch(docs.sparkSession, "runs")  # bounds the rows of an Arrow batch
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found):
    """The run of the greatest length by its period, exactly; of equal ones that of least start, then least period; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(found, none, better)

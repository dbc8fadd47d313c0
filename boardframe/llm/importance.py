"""Quality selection by importance resampling.

Two bags of hashed word unigrams and bigrams are estimated: one from target texts, one from all raw texts. A document's
log-weight is the log-ratio of their likelihoods of its n-grams, a sum over these; Gumbel noise on top and the k largest keys draw k
documents without replacement with probabilities in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.hashing import runs, word_hashes
from boardframe.llm.store import Scratch

BUCKETS = 1 << 17


def features(text: str) -> np.ndarray:
    words = word_hashes(text)
    return (np.concatenate([words, runs(words, 2)]) >> np.uint64(64 - 17)).astype(np.int64)


def counts(texts: DataFrame, smoothing: float) -> np.ndarray:
    """Of each bucket over all rows of ``texts`` (text). A row for each bucket reaches the driver at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = [features(text.as_py()) for text in batch.column(0)]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select("text").where("text IS NOT NULL").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.full(BUCKETS, smoothing)
    out[rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return out


def log_ratio(raw: DataFrame, target: DataFrame, *, smoothing: float = 1.0) -> np.ndarray:
    """Of target to raw, for each bucket."""
    a, b = counts(target, smoothing), counts(raw, smoothing)
    return np.log(a / a.sum()) - np.log(b / b.sum())


def largest(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest value of the double column ``key``, and how many rows equal to it belong to the k largest.

    Counts in 4096 bins narrow the range until one bin holds it; no rows are gathered.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        step = (high - low) / 4096
        if step == 0 or low + step == low:
            break
        bin_ = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(4095)).cast("int")
        counts = keys.where(F.col("key").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high, k - above


def _smallest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th smallest value of a long column, and how many rows equal to it belong to the k smallest. 16 bits at a time are counted."""
    bits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    value = 0
    for shift in (48, 32, 16, 0):
        counts = rows.groupBy(F.shiftrightunsigned(bits, shift).bitwiseAND(0xFFFF).cast("int").alias("part")).count().collect()
        for part, n in sorted((r["part"], r["count"]) for r in counts):
            if n >= k:
                break
            k -= n
        value = value << 16 | part
        rows = rows.where(F.shiftrightunsigned(bits, shift).bitwiseAND(0xFFFF) == part)
    return value - (1 << 63), k


def resample(docs: DataFrame, target: DataFrame, *, keep: float | None = None, seed: int = 0, per_words: float | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, log_weight, key, selected. ``target`` (text) has the wanted kind.

    ``keep`` of the rows are drawn, rounded up; by default as many as have a log-weight above 0, which are those that the
    target explains better than the raw texts do. log_weight is the sum over the text's n-grams, the logarithm of the ratio of both models'
    likelihoods. With ``per_words`` it is the mean over the n-grams times that number: long texts then neither gain nor lose by their
    length, but documents are no longer drawn in proportion to the ratio. Null and empty texts have weight null and are never selected
    before others. The noise depends on ``seed``, doc_id and text only. Of equal keys at the edge the smaller doc_id is drawn (null last),
    of repeated rows any.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    ratio = log_ratio(docs, target).astype(np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for text in batch.column(1):
                found = features(text.as_py() or "")
                weights.append(float(ratio[found].sum() if per_words is None else ratio[found].mean() * per_words) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), batch.column(2)], names=["doc_id", "log_weight", "u"])

    # A uniform number in (0, 1) from 53 bits of a hash.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    weighed = docs.select("doc_id", "text", uniform.alias("u")).mapInArrow(weigh, "doc_id long, log_weight double, u double")
    key = F.coalesce("log_weight", F.lit(-1e300)) - F.log(-F.log("u"))
    rows = scratch.save(weighed.select("doc_id", "log_weight", key.alias("key"), F.monotonically_increasing_id().alias("_row")), "rows")
    total, above = rows.agg(F.count("*"), F.count_if(F.col("log_weight") > 0)).first()
    k = above if keep is None else int(np.ceil(keep * total))
    if not k:
        return rows.drop("_row").withColumn("selected", F.lit(False))
    edge, ties = largest(rows, k)
    drawn, place = F.lit(True), F.coalesce("doc_id", F.lit((1 << 63) - 1))
    equal = rows.where(F.col("key") == F.lit(edge)).select(place.alias("place"), "_row")
    if equal.count() > ties:
        last, more = _smallest(equal, "place", ties)
        row, _ = _smallest(equal.where(F.col("place") == last), "_row", more)
        drawn = (place < last) | ((place == last) & (F.col("_row") <= row))
    return rows.withColumn("selected", (F.col("key") > F.lit(edge)) | ((F.col("key") == F.lit(edge)) & drawn)).drop("_row")

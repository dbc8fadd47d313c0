"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased words. A document is a mixture: every word comes
from one of its languages, and expectation-maximisation estimates their proportions. Which languages a document has is
chosen by penalised likelihood: one more is kept only if it raises the log-likelihood by more than its price.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch
from boardframe.llm.tokens import forget

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Words of a text whose letters are looked up at once.
WORDS_AT_ONCE = 1 << 16
#: Bytes as trigrams see them: ASCII letters and all bytes beyond ASCII stay, others are blank.
SEEN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: Log-probability of each bucket (rows) in each language.
    table: np.ndarray


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets around each letter, and where each word's begin."""
    raw = SEEN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    before, at, after = raw[:-2], raw[1:-1], raw[2:]
    keep = at != 32
    code = (before.astype(np.uint32) << np.uint32(16)) | (at.astype(np.uint32) << np.uint32(8)) | after
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17))[keep]
    return bucket, np.flatnonzero(before[keep] == 32)


def train(labelled: DataFrame, *, smoothing: float = 0.5) -> Model:
    """From all rows of ``labelled`` (text, lang); rows with a null are left out. What reaches the driver is a row for each
    language and bucket at most, whatever the size of the input."""
    Scratch(labelled.sparkSession, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                bucket, _ = trigrams(text.as_py())
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                totals[lang] += np.bincount(bucket, minlength=BUCKETS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "bucket", "n"])

    known = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    counts += smoothing
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def fit(like: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``like`` (words by languages, likelihoods), and the log-likelihood."""
    share = np.full(like.shape[1], 1 / like.shape[1], like.dtype)
    if like.shape[1] > 1:
        for _ in range(rounds):
            new = share * (like.T @ (1 / (like @ share))) / len(like)
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
    return share, float(np.log(like @ share).sum())


def infer(text: str | None, model: Model, penalty: float) -> tuple[str, float, list[str], list[float], float]:
    """Language, score, all languages with their proportions, largest first, and how sure these are: the posterior of one language, 1 of
    several, as each of them has paid its price."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, [], [], 0.0
    bucket, starts = trigrams(text)
    logs = np.empty((len(starts), len(model.languages)))
    for a in range(0, len(starts), WORDS_AT_ONCE):
        part = starts[a : a + WORDS_AT_ONCE + 1]
        end = part[-1] if len(part) > WORDS_AT_ONCE else len(bucket)
        logs[a : a + WORDS_AT_ONCE] = np.add.reduceat(model.table[bucket[part[0] : end]], part[:WORDS_AT_ONCE] - part[0], axis=0)
    like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60))
    share, _ = fit(like)
    whole = logs.sum(0)
    order = np.argsort(-share, kind="stable")
    # One language: the most likely one for all words. More: the largest by proportion, as long as each pays.
    best = [int(whole.argmax())]
    top, shares, price = float(np.log(like[:, best[0]]).sum()), np.ones(1), penalty * np.log1p(len(like))
    for k in range(2, len(order) + 1):
        chosen = [int(x) for x in order[:k]]
        part, value = fit(like[:, chosen])
        if value - price * (k - 1) <= top:
            break
        best, shares, top = chosen, part, value - price * (k - 1)
    rank = sorted(range(len(best)), key=lambda i: (-shares[i], best[i]))
    sure = 1 / np.exp(np.maximum(whole - whole.max(), -700)).sum() if len(best) == 1 else 1.0
    return model.languages[best[rank[0]]], float(min(1.0, shares[rank[0]] * sure)), [model.languages[best[i]] for i in rank], [float(shares[i]) for i in rank], float(sure)


def identify(docs: DataFrame, model: Model, *, penalty: float = 3.0) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, lang_pred, score, languages, proportions.

    Whole texts are read; other columns are not. A null text, or one without a letter, is ``und`` with score 0; so is every
    text if the model knows no language. score is the proportion of the language named, times its posterior where the
    document has one language. ``penalty`` times the logarithm of the words is the price of one more language.
    """
    Scratch(docs.sparkSession, "lang")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [infer(x.as_py(), model, penalty) for x in batch.column(1)]
            lang, score, langs, shares, _ = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "languages", "proportions"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def keep_identified(docs: DataFrame, model: Model, *, min_sure: float = 0.5, penalty: float = 3.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose languages are named with this certainty at least, however many they are."""
    Scratch(docs.sparkSession, "lang")
    place = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [infer(x.as_py(), model, penalty) for x in batch.column(place)]
            yield batch.filter(pa.array([lang != UNDETERMINED and sure >= min_sure for lang, *_, sure in found], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)

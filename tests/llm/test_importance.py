import math
import re
from collections import Counter

import numpy as np

from boardframe.llm.importance import BUCKETS, largest, resample


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return [*words, *zip(words, words[1:])]


def plain(texts, target):
    """Log-weights by counting n-grams themselves, without hashes."""
    count = lambda rows: Counter(g for t in rows for g in grams(t))
    raw, good = count(texts), count(target)
    n, m = sum(raw.values()) + BUCKETS, sum(good.values()) + BUCKETS
    return [sum(math.log((good[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in grams(t)) if grams(t) else None for t in texts]


def test_weights_and_draw(spark):
    good, bad = "the sun rose over green hills", "buy cheap pills now !!!"
    texts = [good if i % 2 else f"{bad} {i}" for i in range(40)] + [None, "", good, good]
    ids = [*range(40), 90, 91, None, 3]
    docs = spark.createDataFrame([(d, t, 1.0, True) for d, t in zip(ids, texts)], "doc_id long, text string, key double, selected boolean").repartition(3)
    target = [t for t in texts if t == good]
    frame = docs.where(f"text = '{good}'")
    want = {(d, t): w for d, t, w in zip(ids, texts, plain(texts, target))}
    for per_words in (None, 100.0):
        got = resample(docs, frame, keep=0.4, per_words=per_words).collect()
        assert len(got) == len(texts) and sum(r["selected"] for r in got) == math.ceil(0.4 * len(texts))
        for r in got:
            d = r["doc_id"]
            text = good if d is None or d % 2 and d < 90 else {90: None, 91: ""}.get(d, f"{bad} {d}")
            weight = want[d, text] if per_words is None or not text else want[d, text] / len(grams(text)) * per_words
            assert r["log_weight"] is None if weight is None else math.isclose(r["log_weight"], weight, rel_tol=1e-9)
        keys = sorted((r["key"] for r in got), reverse=True)
        assert {r["key"] for r in got if r["selected"]} == set(keys[: math.ceil(0.4 * len(texts))])
    assert sorted(map(str, got)) == sorted(map(str, resample(docs, frame, keep=0.4, per_words=100.0).collect()))
    assert sum(r["selected"] for r in resample(docs, frame).collect()) == sum(w is not None and w > 0 for w in want.values()) + 1
    assert resample(docs.where("false"), frame).count() == 0


def test_ties(spark):
    """Equal keys: the smaller doc_id is drawn, beyond what a double tells apart; of repeated rows as many as there is room for."""
    low = (1 << 53) + 1
    rows = [(low, "same"), (low, "same"), (low, "same"), (7, "other text"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k in range(1, 6):
        got = resample(docs, docs, keep=k / 5).collect()
        assert sum(r["selected"] for r in got) == k
        edge = min(r["key"] for r in got if r["selected"])
        assert all(r["selected"] for r in got if r["key"] > edge)
    again = spark.createDataFrame([(1, "")] * 10, "doc_id long, text string")
    assert sum(r["selected"] for r in resample(again, again, keep=0.3).collect()) == 3


def test_draws_by_the_ratio(spark):
    """A text three times as likely under the target is drawn about three times as often, in a small draw."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'aa', 'bb') AS text")
    target = spark.range(4000).selectExpr("IF(id % 4 = 0, 'bb', 'aa') AS text")
    got = resample(docs, target, keep=0.05).collect()
    weight = {r["doc_id"] % 2: math.exp(r["log_weight"]) for r in got}
    drawn = Counter(r["doc_id"] % 2 for r in got if r["selected"])
    want = weight[0] / (weight[0] + weight[1])
    assert abs(drawn[0] / 400 - want) < 4 * math.sqrt(want * (1 - want) / 400) and want > 0.7


def test_gumbel_draws_in_proportion(spark):
    """With equal weights about half of each kind is drawn, whatever the order of rows."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "'same words' AS text")
    got = resample(docs, docs, keep=0.5).where("selected").collect()
    assert len(got) == 1000 and 400 < sum(r["doc_id"] < 1000 for r in got) < 600


def test_largest(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=500).tolist(), *[0.25] * 50, -1e300, 7.0]
    frame = spark.createDataFrame([(float(x),) for x in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 100, 200, 260, 552):
        edge, ties = largest(frame, k)
        assert edge == ordered[k - 1] and ties == k - sum(x > edge for x in values)

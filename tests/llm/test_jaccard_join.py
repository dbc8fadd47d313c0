import random
import re

import pytest

from boardframe.llm import jaccard_join, store
from boardframe.llm.jaccard_join import similar


def sets(docs, n):
    out = []
    for _, text in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        out.append(frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else []))
    return out


def brute(docs, n, percent):
    found, parent = sets(docs, n), list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            same = len(a & found[j])
            if a and found[j] and 100 * same >= percent * (len(a) + len(found[j]) - same):
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(top(i), []).append(docs[i][0])
    return [(docs[i][0], len(found[i]), min((d for d in groups[top(i)] if d is not None), default=None)) for i in range(len(docs))]


def corpus(seed, variants):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and a to".split()) if rng.random() < 0.4 else "".join(rng.choice("abcdeé") for _ in range(4))
    docs, passage = [], [word() for _ in range(30)]
    for _ in range(8):
        base = [word() for _ in range(rng.choice([12, 40, 150, 300]))]
        docs.append(base)
        for _ in range(variants):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += passage[: rng.randint(1, 30)]
            docs.append(copy)
    texts = [" ".join(d) for d in docs] + ["", None, " ", "one", "One", "one two", "a b c", "A b  C\n"]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]


@pytest.mark.parametrize(("n", "percent", "sets"), [(3, 90, 4), (5, 80, 4), (3, 90, 256), (2, 60, 5)])
def test_against_all_pairs(spark, monkeypatch, n, percent, sets):
    monkeypatch.setattr(jaccard_join, "PART_SETS", sets)
    docs = corpus(n + sets, 12)
    frame = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, n int, node binary").repartition(4)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar(frame, words=n, percent=percent).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(docs, n, percent), key=key)


def test_order_and_full_tables_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(store, "DOC_BITS", (4, 4))  # marked documents are too many for it
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "PACKED", 50)
    monkeypatch.setattr(jaccard_join, "PARITY_EACH", 8)
    docs = corpus(9, 6)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=90).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(docs, 3, 90), key=key)


@pytest.mark.parametrize(("part", "cells"), [(256, 1 << 22), (4, 64)])
def test_all_links_are_counted(spark, monkeypatch, part, cells):
    monkeypatch.setattr(jaccard_join, "PART_SETS", part)
    monkeypatch.setattr(jaccard_join, "CELLS", cells)
    base = [f"w{i}" for i in range(200)]
    near = [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(0, 60, 3)]  # all alike, none equal
    chain = [(200 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 150))) for i in range(12)]  # each like its neighbours only
    docs = corpus(4, 8) + near + chain + near[:3]
    found = sets(docs, 3)
    own = set(found) - {frozenset()}
    want = sorted(((d is None, d or 0), sum(a != b and 100 * len(a & b) >= 90 * len(a | b) for b in own) if a else 0) for (d, _), a in zip(docs, found, strict=True))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_links"]) for r in similar(frame, words=3, percent=90).collect())
    assert got == want
    links = dict(got)
    assert links[(False, 103)] > 10 and links[(False, 205)] == 2


def test_empty(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar(frame).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert similar(frame.where("false")).count() == 0

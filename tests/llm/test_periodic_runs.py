"""Periodic runs against a comparison of every word with those each period behind it."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardframe.llm.periodic_runs import collapse, factors, repetitions, text_runs


def plain(words, times, least):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def periodic(draw):
    words = draw(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
    for _ in range(draw(st.integers(0, 3))):
        p = draw(st.integers(1, 8))
        words = words + (words[-p:] * draw(st.integers(1, 5)))
    return words


@settings(max_examples=1500, deadline=None)
@given(periodic(), st.sampled_from([(2, 2), (2, 5), (3, 4), (4, 6), (4, 4), (5, 9)]))
def test_equals_plain(words, bounds):
    found = text_runs(words, *bounds)
    assert found == plain(words, *bounds)
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    assert collapse(words, found) == [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_factors_are_the_longest_that_begin_earlier(words):
    at = 0
    for begin, end, source in factors(words):
        assert begin == at
        at = end
        longest = max((next((k for k in range(len(words) - begin) if words[j + k] != words[begin + k]), len(words) - begin) for j in range(begin)), default=0)
        assert end - begin == max(longest, 1)
        assert (source < 0 and longest == 0) or words[source : source + longest] == words[begin:end]
    assert at == len(words)


def test_long_runs_take_linear_time():
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(9000) for _ in range(5000)] * 12
    assert text_runs(words, 4, 6) == [(0, 60_000, 5000)]


def test_edges(spark):
    rows = [(1, "a b a b a b a b"), (1, "a b a b a b a b"), (2, None), (3, ""), (4, " \n"), (None, "x x x x x x"), (5, "ab" * 300_000), (6, "la " * 50_000), (7, "a b a b a b"), (8, "A a A a a a a a a")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, collapsed string")
    found = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in repetitions(docs).collect()))
    assert [(k, runs, len(text)) for k, runs, text in found] == [(0, [(0, 6, 1)], 1), (1, [(0, 8, 2)], 3), (1, [(0, 8, 2)], 3), (2, [], 0), (3, [], 0), (4, [], 0), (5, [], 600_000), (6, [(0, 50_000, 1)], 2), (7, [], 11), (8, [(3, 6, 1)], 7)]
    assert repetitions(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repetitions(docs, times=1)


def test_query_equals_sql(spark):
    import duckdb

    from boardframe.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.OP11_SQL)
    got = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())

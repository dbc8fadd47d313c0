"""Divergence of sources against its SQL, and radix selection against a sort."""

import random

import duckdb
import pytest

from boardframe.llm import divergence as module
from boardframe.llm import queries
from boardframe.llm.divergence import divergence, term_counts, text_terms, top_ranked
from boardframe.llm.store import Scratch


def plain(docs, least_docs=30, k=50):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = queries.OP12_SQL.replace(">= 30", f">= {least_docs}").replace("rank <= 50", f"rank <= {k}")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def rows(found):
    return sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_equals_sql(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "Of", "éa", "zz", "日本", "x1y", "\U0001f600", "ß", *(chr(97 + i) * 2 for i in range(20))]
    made = []
    for i in range(150):
        # One source has most rows; some groups have no terms, some languages none that are kept.
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "é", None, ""])
        lang = rng.choice(["aa"] * 6 + ["bb", None])
        text = None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.choice([0, 3, 40]))) if source != "s2" else "12 34"
        made.append((lang, source, text, i))
    made += [("rare", "s0", "once", 0), ("rare", "s1", "", 1), ("rare", "s3", "twice", 1), ("aa", "s0", "the of " * 3000, 5)]
    docs = spark.createDataFrame(made, "lang string, source string, text string, terms int")
    assert rows(divergence(docs, least_docs=5, k=4)) == plain(docs, 5, 4)


def test_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string, n int, value string")
    assert divergence(docs).collect() == []
    docs = spark.createDataFrame([("a", "s", None, 1, "v"), ("a", "t", "", 1, "v"), ("a", "t", "", 1, "v")], docs.schema)
    assert rows(divergence(docs)) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_ranked(spark, k):
    rng = random.Random(k)
    made = []
    for key in ("hot", "small", None):
        items = {"".join(rng.choices(["a", "é", "ab", "\U0001f600", "~", "Z"], k=rng.randint(1, 12))) for _ in range({"hot": 3000}.get(key, 20))}
        made += [(key, rng.choice([0, 1, 7, 7, 7, 1 << 21, (1 << 40) + rng.randrange(3)]), item) for item in sorted(items)]
    table = Scratch(spark, "test").save(spark.createDataFrame(made, "key string, value long, item string"), "rows")
    found = top_ranked(table, ["key"], "value", "item", k, Scratch(spark, "test"))
    want = []
    for key in ("hot", "small", None):
        own = sorted((r for r in made if r[0] == key), key=lambda r: (-r[1], r[2].encode()))[:k]
        want += [(*r, i + 1) for i, r in enumerate(own)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_pieces_and_flushes_change_nothing(spark, monkeypatch):
    text = "Ab'cd éÉ_x " * 50 + "end"
    want = [t for part in text_terms(text) for t in part]
    monkeypatch.setattr(module, "PIECE", 7)
    assert [t for part in text_terms(text) for t in part] == want and want[:5] == [b"ab", b"cd", "éÉ".encode(), b"x", b"ab"]
    docs = spark.createDataFrame([("a", "s", text), ("a", "s", "ab"), ("a", None, "ab AB")], "lang string, source string, text string")
    found = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in term_counts(docs).collect()}
    assert found == {("s", "ab"): (51, 2), ("s", "cd"): (50, 1), ("s", "éÉ"): (50, 1), ("s", "x"): (50, 1), ("s", "end"): (1, 1), ("", "ab"): (2, 1)}

"""Every operator on nulls, empty and very long texts, repeated rows, and columns whose names clash with its own."""

import random

import pytest
from pyspark.sql import functions as F

from boardframe.llm.decontaminate import decontaminate
from boardframe.llm.exact_dedup import drop_copies, exact_dedup
from boardframe.llm.importance import resample
from boardframe.llm.jaccard_join import similar
from boardframe.llm.language import identify, keep_identified, train
from boardframe.llm.line_dedup import line_dedup
from boardframe.llm.packing import pack_documents
from boardframe.llm.store import without
from boardframe.llm.suffix_dedup import dedup_strings
from boardframe.llm.token_files import token_files
from boardframe.llm.url_filter import url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SIZE = 600_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=SIZE // 6))
    line = long[:40_000]
    texts = [(1, long), (2, long[:-9] + "changed.."), (3, line), (4, line[:20_000] + "Z" + line[20_001:]), (5, "x" * SIZE), (6, None), (7, ""), (7, ""), (None, "no id"), (None, None), (8, " \t\n"), (9, "é" * 500), (9, "é" * 500)]
    extra = "node string, n int, token long, line string, key string, doc long, rank long, spans string, hash long, word string, seq long, window long, part long, kept boolean, h long, bit int"
    return spark.createDataFrame([(*t, *[None] * 20) for t in texts], f"doc_id long, text string, {extra}, _gone long, _twin long, _own long, _id long").repartition(4).cache()


def test_row_for_row(spark, docs):
    n = docs.count()
    assert exact_dedup(docs).count() == exact_dedup(docs, digest_all=True).count() == n
    assert dedup_strings(docs).count() == n
    assert {r["doc_id"]: r["component_id"] for r in similar(docs).collect()}[2] == 1
    assert similar(docs).count() == n
    model = train(docs.selectExpr("text", "CASE WHEN doc_id < 4 THEN 'aa' WHEN doc_id = 9 THEN 'bb' END AS lang"))
    assert identify(docs, model).count() == n
    assert {r["doc_id"] for r in keep_identified(docs, model).collect()} == {1, 2, 3, 4, 5, 9, None}
    assert resample(docs, docs.where("doc_id = 1")).count() == n
    assert token_files(docs, PATH, end_id=2, vocab_size=49_408).count() == n


def test_others(spark, docs):
    kept = {r["doc_id"] for r in drop_copies(docs).select("doc_id").collect()}
    assert kept == {1, 2, 3, 4, 5, 9, None} | ({6} if 6 in kept else {8})
    gone = docs.where("doc_id > 3").select("doc_id", F.xxhash64("text").alias("twin"))
    assert {r["doc_id"] for r in without(docs, gone).collect()} == {1, 2, 3, None}
    assert {r["doc_id"] for r in without(docs, gone.withColumn("twin", F.col("twin") + 1)).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert {r["doc_id"] for r in decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text").where("item_id = 3")).where("contaminated").collect()} == {1, 2, 3, 4}
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * SIZE, "<p>" * SIZE), (2, None, None), (2, None, None), (3, "", ""), (None, "http://b.org/es/", "x")], "page_id long, url string, html string")
    found = {(r["page_id"], len(r["path"]), r["verdict"]) for r in url_filter(pages, [("block", "org", "/es/")]).collect()}
    assert found == {(1, SIZE + 1, "allow"), (2, 0, "allow"), (3, 0, "allow"), (None, 4, "block")}
    lines = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["kept"]) for r in line_dedup(docs).collect()}
    assert lines[4, 1] == (3, False) and lines[2, 1] == (2, True) and lines[8, 1][1] and (6, 1) not in lines
    pieces = pack_documents(docs, PATH, end_id=2)
    total = token_files(docs, PATH, end_id=2, vocab_size=49_408).agg({"n_tokens": "sum"}).first()[0]
    assert pieces.agg({"length": "sum"}).first()[0] == total

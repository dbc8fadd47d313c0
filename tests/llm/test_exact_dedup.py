import hashlib
import re
from collections import defaultdict

from boardframe.llm import store
from boardframe.llm.exact_dedup import drop_copies, exact_dedup
from boardframe.llm.store import marked, without

TEXTS = ["a b c", "abc", "a  b\tc\n", None, "", " \r\n", "x" * 100, "x" * 99 + "y", "é", "é", "a bc", "a\x1cbc"]
ROWS = [(i, t, "en", 5) for i, t in enumerate(TEXTS)] + [(100, "abc", "en", 5), (100, "abc", "en", 5), (2, "other", "en", 5), (None, "abc", "en", 5)]
SCHEMA = "doc_id long, text string, length string, prefix int"


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    return {(g[3], bare): (min(same)[3], len(same), hashlib.sha256(bare.encode()).hexdigest()) for bare, same in groups.items() for g in same}


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    want = brute(ROWS)
    for every in (True, False):
        got = exact_dedup(docs, prefix_chars=4, digest_all=every).collect()
        assert len(got) == len(ROWS)
        assert sum(r["kept"] for r in got) == len({bare for _, bare in want})
        for r in got:
            key = next(k for k, v in want.items() if k[0] == r["doc_id"] and (v[0], v[1]) == (r["keep_id"], r["group_size"]))
            assert not r["kept"] or r["keep_id"] == r["doc_id"]
            assert r["text_sha256"] == want[key][2] if every or r["refined"] == "full" else r["text_sha256"] is None
            assert r["group_size"] == 1 or r["refined"] == "full"
    assert exact_dedup(docs.where("false")).count() == 0


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = drop_copies(docs)
    assert got.columns == docs.columns
    bare = sorted(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in got.collect())
    assert bare == sorted({bare for _, bare in brute(ROWS)})
    assert drop_copies(docs.where("doc_id < 2")).count() == 1


def test_refinement_moves_no_text(spark):
    """Only hashes and numbers are in the exchanges of the plan, with or without a digest for all."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for every in (True, False):
        plan = exact_dedup(docs, digest_all=every)._jdf.queryExecution().executedPlan().toString()
        assert "bare" not in plan and "text#" not in plan


def test_marks(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    ids = docs.where("doc_id IN (1, 4, 100)").select("doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    gone = docs.where("doc_id IN (1, 4, 100) OR doc_id IS NULL OR text = 'other'").selectExpr("doc_id", "xxhash64(text) AS twin")
    for bits in ((16, 23), (2, 2)):  # the second is too small for the ids, so all rows pass to the join
        monkeypatch.setattr(store, "DOC_BITS", bits)
        assert sorted(r["doc_id"] for r in without(docs, gone).collect()) == [0, 2, 3, 5, 6, 7, 8, 9, 10, 11]
        assert {1, 4, 100, None} <= {r["doc_id"] for r in marked(docs, ids).collect()}
        assert len(drop_copies(docs).collect()) == len({bare for _, bare in brute(ROWS)})

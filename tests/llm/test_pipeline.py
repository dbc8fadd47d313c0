import re

import corpus_pipeline
from boardframe.llm import queries
from boardframe.llm.decontaminate import decontaminate
from boardframe.llm.language import identify, train
from tests.llm.test_support import plain_sets

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = queries.read(spark, SF, "documents")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    rows = {name: {r["doc_id"]: r["text"] for r in frame.collect()} for name, frame in seen.items()}
    model = train(seen["documents"].where("crc32(cast(doc_id AS string)) % 3 <> 1").select("text", "lang"))
    sure = {r["doc_id"] for r in identify(seen["documents"], model).where("lang_pred <> 'und' AND (score >= 0.5 OR size(languages) > 1)").collect()}
    assert rows["language_id"].keys() == sure
    groups = {}
    for doc, text in rows["language_id"].items():
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[bare] = min(groups.get(bare, (0, 1 << 60)), (-len(text or ""), doc))
    assert rows["exact_dedup"].keys() == {doc for _, doc in groups.values()}
    kept = plain_sets(rows["exact_dedup"], 5, 80)
    assert rows["near_dedup"].keys() == kept
    dirty = {r["doc_id"] for r in decontaminate(seen["near_dedup"], queries.read(spark, SF, "benchmark"), short=True).where("contaminated").collect()}
    assert dirty and rows["decontamination"].keys() == rows["near_dedup"].keys() - dirty
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows["decontamination"])
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_rows_of_one_doc_id(spark):
    """Each row goes or stays by its own text."""
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base + " more"), (2, "a wholly different text of its own"), (3, None), (3, "x")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, base), (2, "a wholly different text of its own"), (3, None), (3, "x")], key=str)


def test_empty_documents(spark):
    docs = queries.read(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

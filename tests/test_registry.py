from boardframe.plans import registry


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ids_are_checked_over_their_whole_range(spark, tmp_path):
    lost = {5, 401, 1203, 2500}
    labels = [(i, 1, 0) for i in range(2, 2600) if i not in lost] + [(7, 1, 0), (None, 0, 0)]
    sf = tables(spark, tmp_path, documents=([(i, "a") for i in range(2, 2600)], "doc_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"] for r in registry.QUERIES["expected_ids"](spark, sf).collect()} == lost
    assert [tuple(r) for r in registry.QUERIES["coverage_gate"](spark, sf).collect()] == [(4, 1, 1, False)]


def test_ids_of_no_documents(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=([], "doc_id long, text string"), labels=([(3, 1, 0)], "doc_id long, quality int, toxic int"))
    assert registry.QUERIES["expected_ids"](spark, sf).collect() == []
    assert registry.QUERIES["coverage_gate"](spark, sf).first()["missing"] == 0


def test_scores_need_the_whole_text(spark, tmp_path):
    items = [(0, "a b c"), (1, "a b c"), (2, "a b c"), (3, "a b"), (4, "one"), (5, None), (6, "")]
    docs = [(0, "a b c d"), (3, "a b x d"), (6, "a b"), (9, "a b c"), (12, None), (15, "a"), (18, "a"), (19, "a b c")]
    sf = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([*items, (7, "a b c")], "item_id long, text string"))
    assert [tuple(r) for r in registry.QUERIES["prefix_score"](spark, sf).collect()] == [(8, 3, 1)]

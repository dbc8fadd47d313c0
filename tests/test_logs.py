"""Logs: order of appends, fields that no schema knows, compaction beside readers and writers."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from boardframe.operators import state
from boardframe.sources import files, logs, readers

SCHEMA = "id string, n int"


def frame(spark, *rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def now(spark, path):
    return {r["id"]: r["n"] for r in state.latest(readers.log(spark, path, SCHEMA)).collect()}


def test_appends_are_ordered(spark, tmp_path):
    """Names of part files are random: the second of two appends must win each time."""
    for i in range(25):
        path = f"{tmp_path}/{i}"
        for n in range(4):
            state.append(frame(spark, ("a", n), (f"b{n}", n)), path)
        assert now(spark, path) == {"a": 3, "b0": 0, "b1": 1, "b2": 2, "b3": 3}


def test_order_within_an_append(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 7).selectExpr("CAST(id % 5 AS STRING) AS id", "CAST(id AS INT) AS n")
    state.append(rows, str(tmp_path / "log"))
    assert now(spark, str(tmp_path / "log")) == {str(k): 3995 + k for k in range(5)}


def test_unknown_fields_stay(spark, tmp_path):
    lines = [{"id": "a", "n": 1, "when": "now", "deep": {"x": [1, {"y": None}]}, "ledger": [{"stage": "s", "by": "me"}]}, {"id": "b", "n": "no number", "z": 1.5}, {"id": "a", "n": 2, "deep": {"x": []}, "flag": True}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "old.jsonl").write_text("\n".join(map(json.dumps, lines)))
    path = str(tmp_path / "log")
    logs.compact(spark, path)
    kept = {json.loads(r["value"])["id"]: json.loads(r["value"]) for r in logs.lines(spark, path).collect()}
    assert kept == {"a": lines[2], "b": lines[1]}
    rows = logs.records(spark, path, SCHEMA, extras=True)
    assert {r["id"]: json.loads(r["x"]) for r in rows.select("id", F.to_json("_extra").alias("x")).collect()} == {"a": {"deep": {"x": []}, "flag": True}, "b": {"z": 1.5}}
    # Written back with what an operator changed; a field that became a column is not written twice.
    state.append(rows.withColumn("n", F.coalesce("n", F.lit(9))).withColumn("flag", F.lit("column")), path)
    again = {json.loads(r["value"])["id"]: json.loads(r["value"]) for r in state.latest(logs.records(spark, path, SCHEMA).join(logs.lines(spark, path), "_pos")).collect()}
    assert again == {"a": {"id": "a", "n": 2, "flag": "column", "deep": {"x": []}}, "b": {"id": "b", "n": 9, "flag": "column", "z": 1.5}}


def test_compaction_beside_readers_and_writers(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(3):
        state.append(frame(spark, ("a", n), ("b", 10 * n)), path)
    before = readers.log(spark, path, SCHEMA)  # lists what there is
    first = logs.compact(spark, path)
    assert sorted((r["id"], r["n"]) for r in before.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 10), ("b", 20)]
    assert sorted((r["id"], r["n"]) for r in readers.log(spark, path, SCHEMA).collect()) == [("a", 2), ("b", 20)]
    state.append(frame(spark, ("a", 7)), path)
    assert now(spark, path) == {"a": 7, "b": 20}
    second = logs.compact(spark, path)
    assert readers.log(spark, path, SCHEMA).count() == 2
    gone = logs.vacuum(spark, path)
    assert first in gone and second not in gone and now(spark, path) == {"a": 7, "b": 20}
    state.append(frame(spark, ("b", 1)), path)
    assert now(spark, path) == {"a": 7, "b": 1} and logs.vacuum(spark, path) == []


def test_append_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    state.append(frame(spark, ("a", 1), ("b", 1)), path)
    write, late = logs._write, []

    def slow(lines, at):
        hidden = write(lines, at)
        if not late:
            late.append(1)
            monkeypatch.setattr(logs, "_write", write)
            state.append(frame(spark, ("a", 2)), path)
        return hidden

    monkeypatch.setattr(logs, "_write", slow)
    logs.compact(spark, path)
    assert now(spark, path) == {"a": 2, "b": 1}


@pytest.mark.parametrize("step", ["_write", "rename", "write_text"])
def test_failed_compaction_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "log")
    state.append(frame(spark, ("a", 1), ("a", 2)), path)
    with monkeypatch.context() as patch:
        if step == "_write":
            patch.setattr(logs, step, lambda *_: (_ for _ in ()).throw(OSError("disk")))
        elif step == "write_text":
            patch.setattr(files, step, lambda *_: (_ for _ in ()).throw(OSError("disk")))
        else:
            real, calls = files.rename, []

            def second(*args):
                calls.append(args)
                if len(calls) == 2:  # the pointer
                    raise OSError("disk")
                return real(*args)

            patch.setattr(files, step, second)
        with pytest.raises(OSError):
            logs.compact(spark, path)
    assert sorted(r["n"] for r in readers.log(spark, path, SCHEMA).collect()) == [1, 2]
    logs.compact(spark, path)
    assert [r["n"] for r in readers.log(spark, path, SCHEMA).collect()] == [2]
    logs.vacuum(spark, path, unfinished=True)
    assert [r["n"] for r in readers.log(spark, path, SCHEMA).collect()] == [2] and files.children(spark, f"{path}/_new") == []


def test_concurrent_appends_are_all_kept(spark, tmp_path):
    path = str(tmp_path / "log")
    jobs = [threading.Thread(target=state.append, args=(frame(spark, (f"k{i}", i), ("same", i)), path)) for i in range(6)]
    for job in jobs:
        job.start()
    for job in jobs:
        job.join()
    found = now(spark, path)
    assert {k: v for k, v in found.items() if k != "same"} == {f"k{i}": i for i in range(6)} and found["same"] == now(spark, path)["same"]


def test_many_logs_in_one_plan(spark, tmp_path):
    for book in ("one", "two three", "fo+ur"):
        state.append(frame(spark, ("a", len(book)), ("b", 0)), f"{tmp_path}/{book}/log")
        state.append(frame(spark, ("b", len(book))), f"{tmp_path}/{book}/log")
    logs.compact(spark, f"{tmp_path}/one/log")
    (tmp_path / "five").mkdir()
    (tmp_path / "five" / "log").write_text('{"id": "a", "n": 4}\n{bad\n')
    rows = logs.records(spark, f"{tmp_path}/*/log", SCHEMA, book="log")
    assert sorted((r["book"], r["id"], r["n"]) for r in state.latest(rows, ["book", "id"]).collect()) == sorted([(b, k, len(b)) for b in ("one", "two three", "fo+ur") for k in "ab"] + [("five", "a", 4)])


def test_edges(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.lines(spark, path).count() == 0 and logs.compact(spark, path) is None and logs.vacuum(spark, path) == []
    state.append(frame(spark), path)
    assert logs.lines(spark, path).count() == 0
    state.append(frame(spark, (None, 1), ("a", None), ("ü\n\"", 3)), path)
    assert now(spark, path) == {"a": None, 'ü\n"': 3}
    (tmp_path / "file").write_text('{"id": "a"}')
    with pytest.raises(ValueError):
        logs.compact(spark, str(tmp_path / "file"))


def test_books_of_any_name(spark, tmp_path):
    """Books and pictures by their names as written, a log within a bundle counts, other folders do not."""
    shelf = tmp_path / "bundle" / "my shelf"
    for book in ("b 1%2", "c+ü", "plain"):
        (shelf / book / "problem_images").mkdir(parents=True)
        (shelf / book / "problem_images" / "7* %41+.png").write_bytes(b"x")
    state.append(frame(spark, ("a", 1)), f"{shelf}/b 1%2/bundle/state/puzzles.jsonl")
    (shelf / "c+ü" / "problem_jsons").mkdir()
    (shelf / "c+ü" / "problem_jsons" / "1.json").write_text('{"id": "1", "fen": "f"}')
    found = {r["book"]: (r["problems"], r["maps"], r["bundle"]) for r in readers.books(spark, str(shelf), f"{shelf}/launched").collect()}
    assert found == {"b 1%2": (False, False, True), "c+ü": (True, False, False), "launched": (False, False, False)}
    assert {(r["book"], r["id"], r["image"]) for r in readers.images(spark, f"{shelf}/*").collect()} == {(b, "7 %41+", "7* %41+.png") for b in ("b 1%2", "c+ü", "plain")}
    assert [(r["book"], r["id"]) for r in readers.problems(spark, f"{shelf}/*").collect()] == [("c+ü", "1")]

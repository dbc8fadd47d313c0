"""What keeps queries in proportion on larger tables: rows are dealt to all tasks, and no step is done twice."""

import numpy as np
import pytest

from boardframe.operators import layout
from boardframe.plans import page_queries  # noqa: F401
from boardframe.plans.catalogue import QUERIES
from boardframe.plans.generated import made

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_group_are_dealt_to_all_tasks(spark):
    """A file with one group of rows is read by one task; what is made of its rows is worked on by all."""
    rows = made(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"), "SELECT c_custkey FROM {customer}")
    sizes = [n for n in rows.rdd.glom().map(len).collect() if n]
    assert len(sizes) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["mask_quality", "worst_boards", "occupancy_masks"])
def test_pictures_are_drawn_once(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("MapInPandas") == 1


def test_masks_of_pictures_with_and_without_boards(spark):
    """Rows without a board have no mask, wherever in a batch they stand."""
    board = np.full((180, 180), 255, np.uint8)
    for k in (8, 169):
        board[8:170, k - 1 : k + 2] = board[k - 1 : k + 2, 8:170] = 0
    board[15:24, 15:24] = 0
    blank = np.full((180, 180), 255, np.uint8)
    rows = [(str(i), 180, 180, bytearray((blank if i % 3 == 0 else board).tobytes())) for i in range(7)]
    found = {r["id"]: r["mask"] for r in layout.masks(spark.createDataFrame(rows, "id string, height int, width int, pixels binary").coalesce(1)).collect()}
    assert [found[str(i)] is None for i in range(7)] == [i % 3 == 0 for i in range(7)]
    assert all([s for s, v in m.items() if v == "occupied"] == ["a8"] and len(m) == 64 for m in found.values() if m)


@pytest.mark.parametrize("name", ["unreadable_games", "export_games"])
def test_texts_of_games_are_not_worked_out_again_and_again(spark, name):
    """The plan of a game's text is of some size, not of all the ways in which its parts stand in one another."""
    assert len(plan(QUERIES[name](spark, SF))) < 200_000


def test_equal_rows_are_worked_out_once():
    from boardframe.kernel import columns

    row = ("7k/8/8/8/8/8/8/R6K", "w", "1.Rb2 Kg7 2.Ra1")
    before = columns._repair.cache_info().hits
    assert columns._repair(*row) == columns._repair(*row)
    assert columns._repair.cache_info().hits > before


def test_headers_of_documents_are_found_in_order(spark):
    """In one pass over sorted rows, not a call for each document; also where the document's name is null."""
    from boardframe.operators import entries

    spans = [(doc, page, 0, 0, "Bold", 9, f"{n}. A – B") for doc in ("a", None, "b") for page, n in enumerate([2, 1, 3, 2, 2, 3])]
    frame = spark.createDataFrame(spans, "doc string, page int, line int, seq int, font string, size int, text string")
    found = entries.headers(entries.lines(frame))
    assert sorted(((r["doc"] or "", r["page"], r["number"]) for r in found.collect())) == [(d, p, n) for d in ("", "a", "b") for p, n in ((1, 1), (3, 2), (5, 3))]
    assert "FlatMapGroups" not in plan(found)


def test_files_of_a_shelf_are_listed_by_tasks(spark, tmp_path):
    """No list of files is in the plan, and names are as Spark's own reader gives them."""
    from boardframe.sources import files, readers

    for book in ("b 1", "b2", "c3"):
        folder = tmp_path / "shelf" / book / "problem_jsons"
        folder.mkdir(parents=True)
        for name in ("1#.json", "2 ü+.json", "_no.json", ".no.json", "3.txt", "%41.json"):
            (folder / name).write_text('{"id": "' + name[0] + '", "fen": "ä"}')
    pattern = f"{tmp_path}/shelf/b*"
    own = files.below(spark, pattern, "problem_jsons", ".json")
    plain = spark.read.option("wholetext", True).text(f"{pattern}/problem_jsons/*.json").selectExpr("_metadata.file_path AS file", "value")
    rows = sorted((r["file"], r["value"]) for r in own.collect())
    assert rows == sorted((r["file"], r["value"]) for r in plain.collect()) and len(rows) == 6
    found = readers.problems(spark, pattern)
    assert sorted((r["book"], r["id"]) for r in found.collect()) == [(b, i) for b in ("b 1", "b2") for i in ("%", "1", "2")]
    assert not found.inputFiles()
    assert readers.problems(spark, f"{tmp_path}/none/*").isEmpty() and readers.images(spark, pattern).isEmpty()


def test_many_long_ranges_do_not_meet_every_number(spark, monkeypatch):
    """Each number meets the ranges that end in its part, and one for all that cover it; the rows are those of brute force."""
    import random

    from boardframe.operators import overlay

    monkeypatch.setattr(overlay, "SPAN", 7)
    draw = random.Random(2)
    ranges = [(low := draw.randint(-50, 300), low + draw.choice([-1, 0, 3, 20, 400, 10**12]), f"n{i}", i) for i in range(80)]
    numbers = [draw.randint(-80, 400) for _ in range(150)] + [None, 10**11, 10**13]
    found = overlay.in_ranges(spark.createDataFrame([(n,) for n in numbers], "x long"), spark.createDataFrame(ranges, "low long, high long, name string, place int"), "x")
    held = {n: min(((place, name) for low, high, name, place in ranges if low <= n <= high), default=None) for n in numbers if n is not None}
    assert sorted((r["x"], r["name"]) for r in found.collect()) == sorted((n, held[n][1]) for n in numbers if n is not None and held[n])


def test_small_files_share_tasks(spark):
    """The tasks that read pages grow with the bytes of files, not with their number; a large file is still cut."""
    from boardframe.sources import pages

    small = [(f"{i:06}.pdf", 2000) for i in range(100_000)]
    parts = pages.dealt(small)
    assert len(parts) <= sum(size + pages.OPENED for _, size in small) / pages.SLICE * 1.1 + 1
    assert [one for p in parts for one in p.held] == [(path, 0, 1) for path, _ in small]
    assert 8 <= len(pages.dealt(small[:1000])) <= 100 and pages.dealt([]) == []
    assert [p.held for p in pages.dealt([("a", 3 * pages.SLICE), ("b", 9)])] == [[("a", 0, 3)], [("a", 1, 3)], [("a", 2, 3)], [("b", 0, 1)]]


def test_drawings_are_read_once(spark):
    """Which of them are anchors is seen from each, without a second reading of all files."""
    found = QUERIES["pdf_drawings"](spark, SF)
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1


def test_workers_hold_few_pictures():
    """However many rows a batch has, few are drawn before they are sent on."""
    import pandas as pd

    from boardframe.plans.generated import few

    parts = list(few(iter([pd.DataFrame({"k": range(1000)}), pd.DataFrame({"k": []}), pd.DataFrame({"k": [7]})])))
    assert max(map(len, parts)) <= 64 and [k for p in parts for k in p["k"]] == [*range(1000), 7]


def test_stretches_of_many_pages_in_parts(spark, monkeypatch):
    """The same as pixel by pixel, whatever a worker holds; stretches do not go on from row to row, nor from half to half."""
    monkeypatch.setattr(layout, "SENT", 40)
    dice = np.random.default_rng(5)
    images = [(dice.random((int(dice.integers(1, 12)), int(dice.integers(2, 15)))) < 0.7).astype(np.uint8) * 200 for _ in range(40)]
    want = set()
    for page, image in enumerate(images):
        tall, wide = image.shape
        for half, (a, b) in enumerate(((0, wide // 2), (wide // 2, wide))):
            lines = [(True, y, [(x, image[y, x]) for x in range(a, b)]) for y in range(tall)] + [(False, x, [(y, image[y, x]) for y in range(tall)]) for x in range(a, b)]
            for across, line, dots in lines:
                start = None
                for at, ink in [*dots, (dots[-1][0] + 1 if dots else 0, 255)]:
                    if ink < 128 and start is None:
                        start = at
                    elif ink >= 128 and start is not None:
                        if at - start >= 3:
                            want.add((page, half, across, line, start, at - start))
                        start = None
    rows = [(i, *image.shape, bytearray(image.tobytes())) for i, image in enumerate(images)]
    found = layout.pixel_runs(spark.createDataFrame(rows, "page long, height int, width int, pixels binary").coalesce(1), least=3).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_books_are_looked_for_in_tasks(spark, tmp_path):
    """No file is listed in the driver; empty and hidden ones do not make a book, one at any depth does."""
    from boardframe.sources import readers

    for name, body in {"a/problem_jsons/1.json": "x", "b/bundle/state/deep/p.jsonl": "x", "c/fens.json": "{}", "d/fens.json": "", "e/bundle/.x": "x", "f/bundle/_tmp/x": "x", "g/notes/x": "x", "h+ i/bundle/k=1/x": "x", "l/fens.json": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "j/problem_jsons").mkdir(parents=True)
    found = readers.books(spark, f"file://{tmp_path}", "/elsewhere/l")
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(b, f"file:{tmp_path}/{b}", b == "a", b in "cl", b in ("b", "h+ i")) for b in ("a", "b", "c", "h+ i", "l")}
    assert [tuple(r) for r in readers.books(spark, f"file://{tmp_path}/none", "/elsewhere/l/").collect()] == [("l", "/elsewhere/l", False, False, False)]


def test_glyphs_pass_cells_without_being_sorted(spark):
    """Only what is made of glyphs is put in order, and ranks and boards are counted in what was collected, not once more."""
    found = QUERIES["font_boards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in found and "count(distinct" not in found


def test_a_board_is_decoded_once_for_its_reasons(spark):
    """However often reasons and shifts ask for its letters, the plan replaces digits by dots once."""
    from pyspark.sql import functions as F

    from boardframe.functions import boards

    rows = spark.createDataFrame([("7k/8/8/8/8/8/8/7K",), ("8/8/8/8/8/8/8/7K",), ("P6k/8/8/8/8/8/8/7K",), ("x",), (None,)], "fen string")
    found = rows.select("fen", boards.structural_reason(F.col("fen")).alias("r"), boards.shifts(F.col("fen")).alias("s"))
    assert [r["r"] for r in found.collect()] == [None, "kings: 1 white, 0 black", "pawn on rank 1/8", "unparseable", "unparseable"]
    assert plan(rows.select(boards.structural_reason(F.col("fen")).alias("r"))).count("........") == 1

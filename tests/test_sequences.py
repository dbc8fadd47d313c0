"""Scans of ordered rows in two levels: large groups cut into segments give what plain loops over the rows give."""

import random

import pytest
from pyspark.sql import functions as F

from boardframe.operators import sequences as module
from boardframe.sources import readers


@pytest.fixture(params=[(1 << 16, 32), (20, 3)], ids=["whole", "segments"])
def cut(request, monkeypatch):
    monkeypatch.setattr(module, "SPAN", request.param[0])
    monkeypatch.setattr(module, "PARTS", request.param[1])


def made(spark, seed):
    """A hot group, small ones and one without a name; order by a text, values with gaps."""
    rng, rows = random.Random(seed), []
    for g, n in (("hot", 400), ("b", 25), ("c", 3), ("d", 1), (None, 60)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 1, 2, 5, 40])
            rows.append((g, at, f"{at:07d}", rng.random() < 0.85, rng.choice([None, None, rng.randrange(100)])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, o string, f boolean, v int").repartition(5)


def groups(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r[1]):
        found.setdefault(r[0], []).append(r)
    return found


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("by", [["g"], []])
def test_equal_plain_loops(spark, cut, seed, by):
    rows, frame = made(spark, seed)
    if not by:
        rows = [r for r in rows if r[0] == "hot"]
        frame = frame.where("g = 'hot'")
    own = groups(rows)
    name = (lambda r: r["g"]) if by else (lambda r: "hot")

    got = {(name(r), r["k"]): r["place"] for r in module.numbered(frame, ["o"], by).collect()}
    assert got == {(g, r[1]): i for g, part in own.items() for i, r in enumerate(part)}

    for before in (False, True):
        want = {}
        for g, part in own.items():
            last = None
            for r in part:
                seen = last
                last = last if r[4] is None else r[4]
                want[g, r[1]] = seen if before else last
        got = {(name(r), r["k"]): r["last"] for r in module.carry(frame, F.col("v"), ["o"], by, "last", before=before).collect()}
        assert got == want

    want, gaps = [], []
    for g, part in own.items():
        ks = [r[1] for r in part]
        starts = [i for i, k in enumerate(ks) if not i or k - ks[i - 1] > 4]
        want += [(g, ks[a], ks[b - 1], b - a, (ks[a] + ks[b - 1]) // 2) for a, b in zip(starts, [*starts[1:], len(ks)])]
        steps = [(b - a, -a, a, b) for a, b in zip(ks, ks[1:])]
        gaps += [(g, *max(steps)[2:], max(steps)[0])] if steps else []
    assert sorted(((name(r), r["low"], r["high"], r["n"], r["centre"]) for r in module.runs(frame, "k", by, 4).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(((name(r), r["low"], r["high"], r["gap"]) for r in module.widest_gap(frame, "k", by).collect()), key=repr) == sorted(gaps, key=repr)

    want = {g: max(map(len, "".join("x" if r[3] else " " for r in part).split() or [""])) for g, part in own.items()}
    assert {name(r): r["longest"] for r in module.longest_run(frame, F.col("f"), ["o"], by).collect()} == want
    everywhere = {name(r): r["longest"] for r in module.longest_run(frame, F.lit(True), ["o"], by).collect()}
    assert everywhere == {g: len(part) for g, part in own.items()}
    assert set(r["longest"] for r in module.longest_run(frame, F.lit(None).cast("boolean"), ["o"], by).collect()) == {0}

    want = sorted([(g, i // 2, part[i][1], part[i + 1][1] if i + 1 < len(part) else None) for g, part in own.items() for i in range(0, len(part), 2)], key=repr)
    assert sorted(((name(r), r["pair"], r["first"], r["second"]) for r in module.pairs(frame, "k", ["o"], by).collect()), key=repr) == want


def test_pages_over_segments(spark, cut):
    rng = random.Random(5)
    pages = [(i, [(f"{i}", "m")] if rng.random() < 0.4 else [], f"c{i}" if rng.random() < 0.5 else None) for i in range(300)]
    frame = spark.createDataFrame(pages, "page int, solutions array<struct<id:string,moves:string>>, continuation string").repartition(4)
    want, owner = {}, None
    for i, solutions, more in pages:
        if more and owner is not None:
            want[owner] += f" {more}"
        if solutions:
            owner = i
            want[i] = "m"
    assert {int(r["id"]): r["moves"] for r in module.stitch_pages(frame).collect()} == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, k long, f boolean")
    for found in (module.numbered(empty, ["k"], ["g"]), module.carry(empty, F.col("k"), ["k"], [], "x"), module.runs(empty, "k", [], 1), module.longest_run(empty, F.col("f"), ["k"], ["g"]), module.pairs(empty, "k", ["k"]), module.widest_gap(empty, "k"), module.repeated(empty, "g")):
        assert found.count() == 0


def test_one_group_of_a_million(spark, tmp_path):
    """Of one group with a million rows no task gets more than a segment's share."""
    frame = spark.range(0, 1_000_000, 1, 8).selectExpr("id * 3 + id % 2 AS k", "'hot' AS g", "id % 1000 > 0 AS f")
    cut = module.segments(frame, ["k"], ["g"])
    sizes = [r["count"] for r in cut.groupBy("_seg").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 20_000
    assert module.longest_run(frame, F.col("f"), ["k"], ["g"]).first()["longest"] == 999
    assert module.runs(frame, "k", ["g"], 4).select("low", "high", "n").first() == (0, 2_999_998, 1_000_000)
    assert tuple(module.numbered(frame, ["k"], ["g"]).agg(F.sum("place"), F.max("place")).first()) == (499_999_500_000, 999_999)


def test_lines_over_parts_of_a_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("".join(f"{i}. Ra{i}\n" + (f"lichess x{i}\n" if i % 3 else "") for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.solution_lines(spark, str(tmp_path / "s.txt"))
        found = {int(r["id"]): r["name"] for r in rows.collect()}
        assert rows.select("_pos.block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {i: f"x{i}" if i % 3 else None for i in range(2000)}

"""Repairs that accept only what alone replays: shifted boards, broken move texts, repeated readings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.functions import boards, text
from boardframe.kernel import columns as kernel
from boardframe.kernel import ladder


def shift_repair(fixes: DataFrame, problems: DataFrame, solutions: DataFrame) -> DataFrame:
    """Puzzles whose board is one square off: of all shifts of all readings exactly one board lets the main line replay.

    ``fixes`` (id, status, fen, fen_fast, fen_strong) in status MOVES_SUSPECT or UNRESOLVED; ``problems`` (id, fen), ``solutions``
    (id, moves). Gives id, old_fen, fen, to_move, status, note, rounds.
    """
    open_ = fixes.where(F.col("status").isin("MOVES_SUSPECT", "UNRESOLVED")).select("id", F.col("fen").alias("old_fen"), "fen_fast", "fen_strong")
    rows = open_.join(problems.select("id", boards.placement(F.col("fen")).alias("own")), "id", "left").join(solutions.where("coalesce(moves, '') <> ''").select("id", "moves"), "id")
    readings = F.array_distinct(F.filter(F.array("old_fen", "fen_fast", "fen_strong", "own"), lambda f: f.isNotNull() & (f != "")))
    tried = rows.select("id", "old_fen", "moves", F.explode(readings).alias("reading")).select("*", F.explode(boards.shifts(F.col("reading"))).alias("s"))
    tried = tried.select("id", "old_fen", "moves", "reading", "s.direction", "s.fen").where(boards.structural_reason(F.col("fen")).isNull())
    hits = tried.withColumn("to_move", kernel.main_turn("fen", F.lit("w"), "moves")["turn"]).where("to_move IS NOT NULL")
    how = F.struct("reading", "direction", "fen", "to_move", "old_fen")
    found = hits.groupBy("id").agg(F.min(how).alias("h"), F.min("fen").alias("low"), F.max("fen").alias("high")).where("low = high")
    note = F.concat(F.lit("board shift detected: "), F.col("h.direction"), F.lit(" of "), F.left("h.reading", F.lit(20)))
    return found.select("id", "h.old_fen", "h.fen", "h.to_move", F.lit("SHIFT_FIXED").alias("status"), note.alias("note"), F.lit(0.0).alias("rounds"))


def repair_moves(targets: DataFrame, reread: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``targets`` (id, fen, to_move, moves) to id, fen, to_move, status, note, moves, reocr_text.

    The cheapest repair that replays wins (REPAIRED). What is left is tried with ``reread`` (id, text), a second reading of its page
    (REOCRED). Of those that stay UNREPAIRED, ids that ``earlier`` (id, status) has repaired before are left out.
    """
    turn = F.coalesce(text.first_mover(F.col("moves")), "to_move", F.lit("w"))
    first = targets.select("id", "fen", turn.alias("to_move"), F.col("moves").alias("printed")).withColumn("r", kernel.repair_moves("fen", "to_move", "printed"))
    done = first.where("r.status = 'REPAIRED'").select("id", "fen", "to_move", "r.status", "r.note", "r.moves", F.lit(None).cast("string").alias("reocr_text"))
    left = first.where("r.status <> 'REPAIRED'").select("id", "fen", "to_move", "r.note")
    if reread is None:
        again = left.select("id", "fen", "to_move", F.lit("UNREPAIRED").alias("status"), "note", F.lit(None).cast("string").alias("moves"), F.lit(None).cast("string").alias("reocr_text"))
    else:
        seen = left.join(reread.select("id", F.nullif(F.trim("text"), F.lit("")).alias("text")), "id", "left").withColumn("turn2", F.coalesce(text.first_mover(F.col("text")), "to_move"))
        seen = seen.withColumn("t", kernel.repair_moves("fen", "turn2", F.coalesce("text", F.lit(""))))
        # A second reading may miss a move, but not have a wrong one.
        good = F.col("text").isNotNull() & (F.col("t.status") == "REPAIRED") & (F.col("t.how") != "replaced")
        as_is = (F.col("t.how") == "legal") & ~F.col("t.note").contains(";")
        note = F.when(good, F.concat("note", F.lit("; read again: "), "t.note")).when(F.col("text").isNotNull(), F.concat("note", F.lit("; read again in vain: "), F.col("t.note"))).otherwise(F.col("note"))
        again = seen.select("id", "fen", F.when(good, F.col("turn2")).otherwise(F.col("to_move")).alias("to_move"), F.when(good, "REOCRED").otherwise("UNREPAIRED").alias("status"), note.alias("note"), F.when(good, F.when(as_is, F.col("text")).otherwise(F.col("t.moves"))).alias("moves"), F.when(~good, F.left("text", F.lit(400))).alias("reocr_text"))
    out = done.unionByName(again)
    if earlier is not None:
        kept = earlier.where(F.col("status").isin("REPAIRED", "REOCRED")).select("id").distinct()
        out = out.where("status <> 'UNREPAIRED'").unionByName(out.where("status = 'UNREPAIRED'").join(kept, "id", "left_anti"))
    return out


def _readings(targets: DataFrame, replies: DataFrame, masks: DataFrame) -> DataFrame:
    """What each round of replies says of a target, as boards, captions and squares called empty."""
    said = {r: replies.where(F.col("round") == r).groupBy("id").agg(F.max("text").alias(f"t{r}")) for r in (1, 2, 3)}
    rows = reduce(lambda a, b: a.join(b, "id", "left"), said.values(), targets.select("id", "fen", "to_move", "moves").join(masks.select("id", "mask"), "id", "left"))
    gone = F.regexp_extract_all(F.lower(F.coalesce("t2", F.lit(""))), F.lit(text.EMPTY), 1)
    board = {f"b{r}": text.listing(F.col(f"t{r}")) for r in (1, 2, 3)}
    return rows.select("id", boards.placement(F.col("fen")).alias("old_fen"), "to_move", "moves", "mask", gone.alias("gone"), *(c.alias(n) for n, c in board.items()), text.caption(F.col("t1")).alias("c1"), text.caption(F.col("t3")).alias("c3"))


def second_look(targets: DataFrame, replies: DataFrame, masks: DataFrame) -> DataFrame:
    """id, squares: what a second reading of each target should look at, given the first; none for those without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist(maps_as_pydicts="strict")
            yield pa.RecordBatch.from_pydict({"id": [r["id"] for r in rows], "squares": [ladder.doubtful(r) for r in rows]}, schema=pa.schema([("id", pa.string()), ("squares", pa.list_(pa.string()))]))

    return _readings(targets, replies, masks).where("b1 IS NOT NULL").mapInArrow(run, "id string, squares array<string>")


def read_again(targets: DataFrame, replies: DataFrame, masks: DataFrame) -> DataFrame:
    """Positions settled by recorded readings of their images; each row goes no further than the first stage that settles it.

    ``targets`` (id, fen, to_move, moves), ``replies`` (id, round, text): rounds 1 (a listing), 2 (a closer look at doubtful squares) and 3
    (another reader's listing); ``masks`` (id, mask): which squares look occupied. Gives id, old_fen, fen, to_move, status, rounds, variations_ok,
    note, confidence, fen_fast, fen_strong. Statuses: FIXED, MOVES_SUSPECT (two readings agree), UNRESOLVED, ERROR (no first reading).
    """
    rows = _readings(targets, replies, masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [ladder.settle(row) for row in batch.to_pylist(maps_as_pydicts="strict")]
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return rows.mapInArrow(run, SETTLED)


SETTLED = "id string, old_fen string, fen string, to_move string, status string, rounds double, variations_ok boolean, note string, confidence string, fen_fast string, fen_strong string"
ARROW = pa.schema([(name, {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in SETTLED.split(", "))])

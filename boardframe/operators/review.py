"""What a reviewer sees of each puzzle, in the order of need, and which of their answers are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardframe.functions import boards, text
from boardframe.kernel import columns as kernel
from boardframe.operators import state
from boardframe.operators.audit import tier
from boardframe.operators.overlay import overlay, prefer

ORDER = ("needs-review", "unsolved", "no-solution", "verified", "reviewed")
VERDICTS = ("ok", "fixed", "exclude")
SAVED = "id string, verdict string, fen string, to_move string, moves string"


def outcome(moves: Column, ok: Column, human: Column) -> Column:
    """By what came out, never by which repair ran."""
    return F.when(F.coalesce(moves, F.lit("")) == "", "no-solution").when(~ok, F.when(human, "unsolved").otherwise("needs-review")).when(human, "reviewed").otherwise("verified")


def dataset(problems: DataFrame, solutions: DataFrame, fen_fixes: DataFrame, move_fixes: DataFrame, overrides: DataFrame, images: DataFrame, bundle: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """One row for each problem with an image: id, fen, to_move, source, moves, audit, review, verdict, breaks_at, candidates, tier, priority.

    Human over bundle over accepted repair over original. With a bundle a solution is judged as the export does, else by the
    tokens of its main line.
    """
    f = state.latest(fen_fixes).select("id", "status", "fen", "to_move", "note", "confidence", "fen_fast", "fen_strong")
    m = state.latest(move_fixes).select("id", "status", "moves")
    h = state.latest(overrides).select("id", "verdict", "fen", "to_move", "moves")
    none = "CAST(NULL AS string)"
    b = state.latest(bundle).select("id", "fen", "to_move", "moves") if bundle is not None else problems.where("false").selectExpr("id", f"{none} AS fen", f"{none} AS to_move", f"{none} AS moves")
    a = audit.select("id", "status") if audit is not None else problems.where("false").selectExpr("id", f"{none} AS status")
    own = problems.withColumn("id", text.bare_id(F.col("id")))
    rows = overlay(own.join(images.select("id", "image"), "id"), (solutions.select("id", "moves"), "s_"), (f, "f_"), (m, "m_"), (h, "h_"), (b, "b_"), (a, "a_"))

    human = F.col("h_verdict").isNotNull()
    accepted = F.col("f_status").isin(*state.ACCEPTED_FENS) & (F.coalesce("f_fen", F.lit("")) != "")
    unresolved = F.coalesce(F.col("f_status") == "UNRESOLVED", F.lit(False))
    fen = boards.placement(prefer(F.col("h_fen"), F.col("b_fen"), F.when(accepted, F.col("f_fen")), F.col("fen")))
    source = F.when(F.coalesce("h_fen", F.lit("")) != "", "human").when(unresolved, "fix:UNRESOLVED").when(accepted, F.concat(F.lit("fix:"), "f_status")).otherwise("original")
    mended = F.when(F.col("m_status").isin(*state.ACCEPTED_MOVES), F.col("m_moves"))
    rows = rows.withColumns({"x_fen": fen, "source": source, "x_moves": prefer(F.col("h_moves"), F.col("b_moves"), mended, F.col("s_moves"))})
    rows = rows.withColumn("x_turn", F.coalesce(F.nullif("h_to_move", F.lit("")), "b_to_move", "f_to_move", text.first_mover(F.col("x_moves")), "to_move", F.lit("w")))
    with_moves = rows.where("x_moves IS NOT NULL").withColumn("r", kernel.replay_tokens("x_fen", "x_turn", text.fold_moves(F.col("x_moves"))))
    if bundle is not None:
        with_moves = with_moves.withColumn("ok", kernel.export_text("x_fen", "x_turn", "x_moves")["tier"] != "unparsed")
    else:
        with_moves = with_moves.withColumn("ok", (F.col("r.total") > 0) & (F.col("r.n") == F.col("r.total")))
    blank = rows.where("x_moves IS NULL").withColumns({"r": F.lit(None).cast(with_moves.schema["r"].dataType), "ok": F.lit(False)})
    rows = with_moves.unionByName(blank)

    review = outcome(F.col("x_moves"), F.col("ok"), human)
    stuck = ~F.col("ok") & (F.col("r.n") < F.col("r.total"))
    breaks = F.when(stuck, F.struct((F.col("r.n") + 1).alias("ply"), F.col("r.token").alias("san"), F.col("r.candidates").alias("candidates")))
    choices = F.when(unresolved, F.array_distinct(F.filter(F.array(boards.placement(F.col("fen")), F.col("f_fen_fast"), F.col("f_fen_strong")), lambda x: F.coalesce(x, F.lit("")) != ""))).otherwise(F.array().cast("array<string>"))
    own_tier = F.when(human, "HUMAN").otherwise(tier(F.col("s_moves"), F.coalesce("f_note", F.lit("")), F.coalesce("f_confidence", F.lit("")), F.lit(None).cast("int")))
    priority = F.array_position(F.array(*map(F.lit, ORDER)), review).cast("int")
    return rows.select("id", F.col("x_fen").alias("fen"), F.col("x_turn").alias("to_move"), "source", F.col("x_moves").alias("moves"), F.coalesce("a_status", F.lit("?")).alias("audit"), review.alias("review"), F.col("h_verdict").alias("verdict"), breaks.alias("breaks_at"), choices.alias("candidates"), own_tier.alias("tier"), priority.alias("priority"), "image")


def queue(rows: DataFrame, wanted: str = "all") -> DataFrame:
    """In order of priority and number: all, ``doubtful`` tiers only, or one outcome."""
    if wanted == "doubtful":
        rows = rows.where(F.col("tier").isin("LOW", "MEDIUM"))
    elif wanted != "all":
        rows = rows.where(F.col("review") == wanted)
    return rows.orderBy("priority", text.sort_number(F.col("id")), "id")


def old_notation(rows: DataFrame) -> DataFrame:
    """Rows (id, fen, to_move, moves) in older notation: id and what stands in the way: converts, damaged or position."""
    found = rows.where(text.is_old_notation(F.col("moves"))).select("id", kernel.old_notation("fen", "to_move", "moves").alias("o"))
    return found.select("id", F.when(F.col("o.converts"), "converts").when(~F.col("o.clean"), "damaged").otherwise("position").alias("note"))


def checked(saved: DataFrame) -> DataFrame:
    """Answers (id, verdict, fen, to_move, moves) with ``reason``, null for those to be taken."""
    fen = boards.placement(F.col("fen"))
    bad = F.when(F.coalesce("id", F.lit("")) == "", "no id").when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
    bad = bad.when((F.col("verdict") != "exclude") & boards.structural_reason(fen).isNotNull(), F.concat(F.lit("structure: "), boards.structural_reason(fen)))
    bad = bad.when((F.col("verdict") != "exclude") & ~F.coalesce(F.col("to_move").isin("w", "b"), F.lit(False)), "unknown side")
    rows = saved.withColumn("reason", bad)
    edited = rows["reason"].isNull() & (F.coalesce("verdict", F.lit("")) != "exclude") & (F.coalesce("moves", F.lit("")) != "")
    tried = rows.where(edited).withColumn("r", kernel.replay_tokens(fen, "to_move", text.fold_moves(F.col("moves"))))
    reason = F.when(F.col("r.total") == 0, "no moves").when(F.col("r.n") < F.col("r.total"), F.concat(F.lit("stops at ply "), (F.col("r.n") + 1).cast("string")))
    return tried.withColumn("reason", reason).drop("r").unionByName(rows.where(~F.coalesce(edited, F.lit(False))))

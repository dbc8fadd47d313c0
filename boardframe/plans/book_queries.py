"""Queries of the operators on books, over puzzles, boards and texts generated from the driver's tables.

The oracle works out what a rook or a knight may do from where it stands, or builds the expected text from the same parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boardframe.functions import boards, text
from boardframe.kernel import columns as kernel
from boardframe.operators import audit, export, repair, review, state
from boardframe.plans.catalogue import query
from boardframe.plans.generated import BOARDS, PRINTED, PUZZLES, digit, made, named, oracle, placed

RECORD = "id, CAST(NULL AS STRING) AS image, board AS fen, side AS to_move, moves, CASE WHEN d12 = 0 THEN 'excluded' WHEN d12 = 1 THEN 'approved' ELSE 'recognized' END AS status, 0 AS difficulty, CAST(NULL AS STRING) AS game_name, CAST(NULL AS STRING) AS hint, CAST(NULL AS STRUCT<fen: STRING, moves: STRING>) AS sources, CAST(NULL AS ARRAY<STRUCT<stage: STRING, verdict: STRING, detail: STRING>>) AS ledger"


def _records(t):
    return made(t, named(PRINTED, select=f"SELECT {RECORD} FROM printed"))


#: The side that the text's numbering or else the record names; whether both differ; and whether the rook's side is asked to move.
TURNED = oracle(PRINTED) + ", turned AS (SELECT *, CASE WHEN numbered AND NOT blank THEN 'w' ELSE side END AS turn, numbered AND NOT blank AND side = 'b' AS odd FROM printed)"


@query(named(TURNED, select="""
SELECT id, CASE WHEN broken THEN 'STRUCT' WHEN blank THEN 'NO_SOL' WHEN turn = 'b' THEN CASE WHEN main_ok THEN 'TURN' ELSE 'ILLEGAL' END
  WHEN full_ok THEN CASE WHEN odd THEN 'TURN' ELSE 'OK' END WHEN main_ok THEN CASE WHEN odd THEN 'TURN' ELSE 'VAR_ONLY' END ELSE 'ILLEGAL' END AS status,
  CASE WHEN odd AND NOT broken THEN 'json says b, solution starts with w' END AS turn_mismatch FROM turned"""))
def audit_waterfall(t):
    return audit.audit(_records(t)).select("id", "status", "turn_mismatch")


VERIFIED = named(TURNED + """, verified AS (SELECT id, d12, CASE WHEN d12 < 2 THEN NULL WHEN broken THEN 'needs_review' WHEN blank THEN 'no_solution' WHEN main_ok THEN 'verified' ELSE 'needs_review' END AS verdict,
  CASE WHEN d12 < 2 OR broken OR blank THEN side WHEN main_ok THEN 'w' WHEN numbered THEN turn ELSE side END AS to_move FROM turned)""", select="")


@query(VERIFIED + "SELECT id, to_move, CASE d12 WHEN 0 THEN 'excluded' WHEN 1 THEN 'approved' ELSE verdict END AS status FROM verified")
def verify_waterfall(t):
    return audit.verify(_records(t)).select("id", "to_move", "status")


@query(VERIFIED + "SELECT verdict, count(*) AS n FROM verified WHERE verdict IS NOT NULL GROUP BY 1")
def verdict_counts(t):
    return state.counts(audit.verify(_records(t)).where("verdict IS NOT NULL"), "verdict")


@query(named(TURNED, select="""
SELECT id, CASE WHEN blank THEN 'NO_SOL' WHEN NOT broken AND turn = 'w' AND main_ok THEN 'OK' WHEN broken AND turn = 'w' AND main_ok THEN 'OK' ELSE 'ILLEGAL' END AS status,
  CASE WHEN blank OR (turn = 'w' AND main_ok) THEN '' ELSE 'stops at ply 1 (R' || s2 || ')' END AS detail FROM turned"""))
def live_audit(t):
    return audit.live_audit(_records(t))


@query(named(oracle(PUZZLES), select="""
SELECT id, CAST(CASE WHEN NOT go12 THEN 0 WHEN NOT go23 THEN 2 ELSE 3 END AS BIGINT) AS plies,
  CASE WHEN go12 THEN '6k1/' ELSE '7k/' END || """ + " || '/' || ".join(f"CASE WHEN r = {r} THEN (CASE WHEN f = 0 THEN '' ELSE CAST(f AS STRING) END) || 'R' || CAST(7 - f AS STRING) ELSE '8' END" for r in range(7, 1, -1)) + """ || '/7K' AS board,
  CASE WHEN NOT go12 THEN 'R' || s2 WHEN NOT go23 THEN 'R' || s3 END AS stops
FROM (SELECT *, CASE WHEN NOT go12 THEN f1 WHEN go23 THEN f3 ELSE f2 END AS f, CASE WHEN NOT go12 THEN r1 WHEN go23 THEN r3 ELSE r2 END AS r FROM puzzles)"""))
def token_replays(t):
    rows = made(t, named(PUZZLES, select="SELECT id, fen, '1.R' || s2 || ' Kg8 2.R' || s3 AS moves FROM puzzles"))
    found = rows.select("id", kernel.replay_tokens("fen", F.lit("w"), "moves").alias("r"))
    return found.select("id", F.col("r.n").cast("long").alias("plies"), boards.placement(F.col("r.fen")).alias("board"), F.col("r.token").alias("stops"))


# Tiers: a variation of the move before it, one printed before the move it varies, and moves that do not replay.
EXPORTED = """
SELECT id, CAST(NULL AS STRING) AS image, fen, 'w' AS to_move, CASE WHEN d7 = 0 THEN NULL ELSE '1.R' || s2 || (CASE WHEN d8 < 5 THEN ' (1.R' || s3 || ')' WHEN d8 < 10 THEN ' (1...Kg8) Kg7' ELSE '' END) END AS moves,
  CASE WHEN d9 = 0 THEN 'excluded' ELSE 'verified' END AS status, CASE WHEN d10 < 8 THEN 'Ann' || id || '-Bob, Rome 1950' END AS game_name, CASE WHEN d11 < 8 THEN 'look {at} it' END AS hint, d7, d8, s2, s3, go12, go13, r2 FROM puzzles WHERE KEPT"""
TIERS = named(oracle(PUZZLES), f"x AS ({EXPORTED.replace('KEPT', 'd9 > 0')})", """y AS (SELECT *, CASE WHEN d7 = 0 OR NOT go12 THEN 'unparsed' WHEN d8 < 5 THEN CASE WHEN go13 THEN 'full' ELSE 'mainline' END
  WHEN d8 < 10 THEN CASE WHEN r2 < 7 THEN 'transformed' ELSE 'unparsed' END ELSE 'full' END AS tier FROM x)""", """z AS (SELECT *, CASE WHEN d7 = 0 THEN '*' WHEN tier = 'unparsed' THEN '{ Book solution (text): ' || moves || ' } *'
  WHEN tier = 'mainline' THEN '{ Book solution (verbatim): ' || moves || ' } 1. R' || s2 || ' *' WHEN tier = 'transformed' THEN '1. R' || s2 || ' Kg7 (1... Kg8) *'
  WHEN d8 < 5 THEN '1. R' || s2 || ' (1. R' || s3 || ') *' ELSE '1. R' || s2 || ' *' END AS body,
  '[Event "Book: Puzzle ' || id || ' (White to move)"]' || chr(10) || CASE WHEN game_name IS NULL THEN '' ELSE '[Site "Rome"]' || chr(10) || '[Date "1950.??.??"]' || chr(10) END || '[Round "' || id || '"]' || chr(10) ||
  CASE WHEN game_name IS NULL THEN '[White "Puzzle ' || id || '"]' || chr(10) || '[Black "White to move"]' ELSE '[White "Ann' || id || '"]' || chr(10) || '[Black "Bob"]' END || chr(10) ||
  '[Result "*"]' || chr(10) || '[SetUp "1"]' || chr(10) || '[FEN "' || fen || ' w - - 0 1"]' || chr(10) || chr(10) AS head FROM y)""", select="")


def _games(t, kept="d9 >= 0"):
    return made(t, named(PUZZLES, select=EXPORTED.replace("KEPT", kept)))


@query(TIERS + """SELECT id, tier, head || body AS solution, head || CASE WHEN hint IS NULL THEN '' ELSE '{ look ''at'' it } ' END || '*' AS problem,
  CASE WHEN tier = 'unparsed' THEN 'review' ELSE 'verified' END AS file FROM z""")
def export_games(t):
    found = export.games(_games(t), "Book")
    return found.select("id", "tier", F.col("solutions").alias("solution"), F.col("problems").alias("problem"), F.when(F.col("verified").isNotNull(), "verified").when(F.col("review").isNotNull(), "review").alias("file"))


@query(TIERS + """SELECT count(*) FILTER (tier = 'full') AS "full", count(*) FILTER (tier = 'transformed') AS transformed, count(*) FILTER (tier = 'mainline') AS mainline, count(*) FILTER (tier = 'unparsed') AS unparsed,
  (SELECT count(*) FROM puzzles) - count(*) AS skipped FROM z""")
def export_stats(t):
    rows = _games(t)
    return export.stats(export.games(rows, "Book"), rows)


@query(TIERS + "SELECT id, CAST(1 AS BIGINT) AS errors FROM z WHERE tier = 'mainline' OR tier = 'full' AND d8 >= 10")
def unreadable_games(t):
    """Games whose file was damaged after it was written: a rook's move reads as a knight's."""
    found = export.games(_games(t), "Book").withColumn("verified", F.regexp_replace("verified", r"1\. R([a-f][2-7]) \*$", r"1. N$1 *"))
    return export.bad_games(found, "verified").select("id", F.col("errors").cast("long").alias("errors"))


# One broken thing each: none, a wrong piece, a reply left out (found where there is but one), two wrong moves.
BROKEN = """CASE d7 % 4 WHEN 0 THEN '1.R' || s2 WHEN 1 THEN '1.N' || s2 WHEN 2 THEN '1.R' || s2 || ' R' || s3 ELSE '1.b4 R' || s2 END"""


@query(named(oracle(PUZZLES), select="""
SELECT id, CASE WHEN moves IS NULL THEN 'UNREPAIRED' ELSE 'REPAIRED' END AS status, moves FROM (SELECT id, CASE
  WHEN d7 % 4 < 2 THEN CASE WHEN go12 THEN '1. R' || s2 END
  WHEN d7 % 4 = 2 THEN CASE WHEN go12 AND go23 AND r2 = 7 THEN '1. R' || s2 || ' Kg8 2. R' || s3 END END AS moves FROM puzzles)"""))
def move_repairs(t):
    rows = made(t, named(PUZZLES, select=f"SELECT id, fen, 'w' AS to_move, {BROKEN} AS moves FROM puzzles"))
    return repair.repair_moves(rows).select("id", "status", "moves")


# Two rooks on one row, a and f; a later move of one of them tells which one has moved.
TWO_ROOKS = """places AS (SELECT c_custkey AS k, md5(CAST(c_custkey AS STRING)) AS h FROM {customer}),
lines AS (SELECT CAST(k AS STRING) AS id, 2 + D1 % 6 AS r, 2 + (D1 + 1 + D2 % 5) % 6 AS r2, substr('bcde', CAST(D3 % 4 AS INT) + 1, 1) AS c, D4 % 3 AS kind FROM places)""".replace("D1", digit(1)).replace("D2", digit(2)).replace("D3", digit(3)).replace("D4", digit(4))
TWO_BOARD = "'7k/' || " + " || '/' || ".join(f"CASE WHEN r = {r} THEN 'R4R2' ELSE '8' END" for r in range(7, 1, -1)) + " || '/7K'"


@query(named(oracle(TWO_ROOKS), select="""
SELECT id, CASE WHEN kind = 2 THEN 'UNREPAIRED' ELSE 'REPAIRED' END AS status, CASE kind WHEN 0 THEN '1. Rf' || c || CAST(r AS STRING) || ' Kg8 2. Ra' || CAST(r2 AS STRING) WHEN 1 THEN '1. Ra' || c || CAST(r AS STRING) || ' Kg8 2. Rf' || CAST(r2 AS STRING) END AS moves FROM lines"""))
def line_disambiguation(t):
    rows = made(t, named(TWO_ROOKS, select=f"SELECT id, {TWO_BOARD} AS fen, 'w' AS to_move, '1.R' || c || CAST(r AS STRING) || CASE kind WHEN 0 THEN ' Kg8 2.Ra' || CAST(r2 AS STRING) WHEN 1 THEN ' Kg8 2.Rf' || CAST(r2 AS STRING) ELSE '' END AS moves FROM lines"))
    return repair.repair_moves(rows).select("id", "status", "moves")


@query(named(oracle(PUZZLES), select="""
SELECT id, CASE WHEN d7 % 3 = 1 THEN 'damaged' WHEN hop12 THEN 'converts' ELSE 'position' END AS note,
  CASE WHEN d7 % 3 <> 1 AND hop12 THEN '1. N' || s2 || CASE WHEN s2 = 'f7' THEN '+' ELSE '' END END AS moves FROM puzzles"""))
def older_notation(t):
    rows = made(t, named(PUZZLES, select="SELECT id, knight AS fen, 'w' AS to_move, '1. S' || s2 || CASE WHEN d7 % 3 = 1 THEN ' §e5' WHEN d7 % 3 = 2 THEN '' ELSE ' (threat)' END AS moves FROM puzzles"))
    return review.old_notation(rows).join(repair.repair_moves(rows).select("id", "moves"), "id").select("id", "note", "moves")


# A board read one square off in some direction: only the boards one step on can be right.
SHIFTED = f"""keys AS (SELECT c_custkey AS k, md5(CAST(c_custkey AS STRING)) AS h FROM {{customer}}),
near AS (SELECT CAST(k AS STRING) AS id, 1 + {digit(1)} % 4 AS f1, 3 + {digit(2)} % 4 AS r1, 1 + {digit(3)} % 4 AS f2, 3 + {digit(4)} % 4 AS r2, CASE {digit(5)} % 4 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'MOVES_SUSPECT' ELSE 'UNRESOLVED' END AS status FROM keys),
moved AS (SELECT *, substr('abcdefgh', CAST(f2 AS INT) + 1, 1) || CAST(r2 AS STRING) AS s2 FROM near)"""


def _two_kings(f, r, kf, up):
    rows = {8: None, 7 + up: f"CASE WHEN {kf} = 0 THEN '' ELSE CAST({kf} AS STRING) END || 'k' || CASE WHEN {kf} = 7 THEN '' ELSE CAST(7 - {kf} AS STRING) END", 2 + up: f"CASE WHEN {kf} = 0 THEN '' ELSE CAST({kf} AS STRING) END || 'K' || CASE WHEN {kf} = 7 THEN '' ELSE CAST(7 - {kf} AS STRING) END"}
    return " || '/' || ".join(rows.get(y) or f"CASE WHEN {r} = {y} THEN CASE WHEN {f} = 0 THEN '' ELSE CAST({f} AS STRING) END || 'R' || CAST(7 - {f} AS STRING) ELSE '8' END" for y in range(8, 0, -1))


STEPS = " UNION ALL ".join(f"SELECT id, status, '{way}' AS way, (f1 + {dx} = f2) <> (r1 + {dy} = r2) AS go, {_two_kings(f'(f1 + {dx})', f'(r1 + {dy})', f'(6 + {dx})', dy)} AS fen FROM moved" for way, dx, dy in (("up", 0, 1), ("down", 0, -1), ("left", -1, 0), ("right", 1, 0)))


@query(named(oracle(SHIFTED), f"steps AS ({STEPS})", select="SELECT id, max(fen) AS fen, max(way) AS way, 'w' AS to_move FROM steps WHERE go AND status <> 'FIXED' GROUP BY id HAVING count(*) = 1"))
def shift_repairs(t):
    rows = made(t, named(SHIFTED, select=f"SELECT id, status, {_two_kings('f1', 'r1', '6', 0)} AS fen, CAST(NULL AS STRING) AS fen_fast, CAST(NULL AS STRING) AS fen_strong, '1.R' || s2 AS moves FROM moved"))
    found = repair.shift_repair(rows.drop("moves"), rows.select("id", "fen"), rows.select("id", "moves"))
    return found.select("id", "fen", F.regexp_extract("note", r": (\w+) of", 1).alias("way"), "to_move")


# Readings of a diagram: the rook on its own square or on a wrong one, from where it does not reach s2.
READINGS = PUZZLES + """,
read AS (SELECT id, s2, d7 % 5 AS kind, f2, r2, fen, substr('abcdefgh', CAST(f2 AS INT) + 1, 1) || CAST(2 + (r2 + 1) % 6 AS STRING) AS own, substr('abcdefgh', CAST((f2 + 1) % 6 AS INT) + 1, 1) || CAST(2 + (r2 - 1) % 6 AS STRING) AS wrong,
  2 + (r2 + 1) % 6 AS own_r, 2 + (r2 - 1) % 6 AS wrong_r, (f2 + 1) % 6 AS wrong_f FROM puzzles),
said AS (SELECT *, 'h1: white king' || chr(10) || 'H8 - Black King' || chr(10) || 'caption: White to move' || chr(10) AS both FROM read)"""


def _rook_at(f, r):
    return "'7k/' || " + " || '/' || ".join(f"CASE WHEN {r} = {y} THEN CASE WHEN {f} = 0 THEN '' ELSE CAST({f} AS STRING) END || 'R' || CAST(7 - {f} AS STRING) ELSE '8' END" for y in range(7, 1, -1)) + " || '/7K'"


@query(named(oracle(READINGS), select=f"""
SELECT id, CASE kind WHEN 3 THEN 'MOVES_SUSPECT' WHEN 4 THEN 'ERROR' ELSE 'FIXED' END AS status, CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 END AS DOUBLE) AS rounds,
  CASE WHEN kind < 3 THEN {_rook_at('f2', 'own_r')} WHEN kind = 3 THEN {_rook_at('wrong_f', 'wrong_r')} END AS fen, 'w' AS to_move FROM said"""))
def reading_ladder(t):
    rows = made(t, named(READINGS, select="SELECT id, fen, 'w' AS to_move, '1.R' || s2 AS moves, kind, both, own, wrong FROM said"))
    lines = [(1, "kind < 4", "both || CASE WHEN kind = 0 THEN own ELSE wrong END || ': white rook'"), (2, "kind = 1", "wrong || ': empty' || chr(10) || own || ': white rook'"), (3, "kind IN (2, 3)", "both || CASE WHEN kind = 2 THEN own ELSE wrong END || ' : white rook'")]
    said = [rows.where(where).selectExpr("id", f"{n} AS round", f"{what} AS text") for n, where, what in lines]
    masks = rows.where("false").selectExpr("id", "CAST(NULL AS MAP<STRING, STRING>) AS mask")
    return repair.read_again(rows.select("id", "fen", "to_move", "moves"), said[0].union(said[1]).union(said[2]), masks).select("id", "status", "rounds", "fen", "to_move")


SAVES = """CASE WHEN d7 = 0 THEN '' ELSE id END AS id, CASE d8 % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'fixed' WHEN 2 THEN 'exclude' ELSE 'maybe' END AS verdict, CASE WHEN d9 = 0 THEN '8/8' ELSE fen END AS fen, CASE WHEN d10 = 0 THEN 'x' ELSE 'w' END AS to_move, CASE WHEN d11 < 4 THEN NULL WHEN d11 = 4 THEN 'text' ELSE '1.R' || s2 END AS moves"""


@query(named(oracle(PUZZLES), f"saved AS (SELECT {SAVES}, s2, go12, k FROM puzzles)", select="""
SELECT k, CASE WHEN id = '' THEN 'no id' WHEN verdict = 'maybe' THEN 'unknown verdict' WHEN verdict = 'exclude' THEN NULL WHEN fen = '8/8' THEN 'structure: unparseable' WHEN to_move = 'x' THEN 'unknown side'
  WHEN moves IS NULL THEN NULL WHEN moves = 'text' THEN 'no moves' WHEN NOT go12 THEN 'stops at ply 1' END AS reason FROM saved"""))
def save_checks(t):
    return review.checked(made(t, named(PUZZLES, select=f"SELECT {SAVES}, k FROM puzzles"))).select("k", "reason")


# Truth and run of the scorer: a wrong square, a wrong side, moves that go on or stop short, missing puzzles.
@query(named(oracle(PUZZLES), select="""
SELECT count(*) AS n, count(*) FILTER (d7 > 0 AND d8 > 1) AS fen_ok, count(*) FILTER (d7 > 0 AND d9 > 2) AS turn_ok, count(*) FILTER (d7 > 0 AND d10 > 3) AS moves_ok, count(*) FILTER (d7 = 0) AS missing,
  round(count(*) FILTER (d7 > 0 AND d8 > 1) * 100.0 / count(*), 1) AS fen_pct, count(*) FILTER (d7 > 0 AND d8 > 1) = count(*) AS passed FROM puzzles"""))
def score_run(t):
    truth = made(t, named(PUZZLES, select="SELECT id, fen || ' w - - 0 1' AS fen, 'R' || s2 || ' Kg8' AS moves FROM puzzles"))
    run = made(t, named(PUZZLES, select="SELECT id, CASE WHEN d8 > 1 THEN fen ELSE knight END AS fen, CASE WHEN d9 > 2 THEN 'w' ELSE 'b' END AS to_move, CASE WHEN d10 > 9 THEN '1.R' || s2 || ' Kg8' WHEN d10 > 3 THEN '1.R' || s2 || ' {x} Kg8 2.R' || s3 ELSE '1.R' || s2 END AS moves FROM puzzles WHERE d7 > 0"))
    return audit.score(truth, run).select("n", "fen_ok", "turn_ok", "moves_ok", "missing", F.col("fen_pct").cast("double").alias("fen_pct"), "passed")


# Solutions of one to eight moves, some with captures or marks.
ANCHORED = named(oracle(PUZZLES), """lines AS (SELECT *, 1 + d7 % 8 AS n, CASE d8 % 3 WHEN 0 THEN 'x' ELSE '' END AS mark, d9 = 0 AS low, d10 = 0 AS arbitrated, d11 = 0 AS blank, CASE WHEN d12 < 3 THEN d12 END AS off FROM puzzles)""",
  """tiers AS (SELECT *, CASE WHEN low OR arbitrated THEN 'LOW' WHEN blank THEN 'MEDIUM' WHEN (n >= 6 OR n >= 4 AND mark = 'x') AND coalesce(off, 0) = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM lines)""", select="")


def _anchored(t):
    rows = made(t, named(PUZZLES, "lines AS (SELECT *, CAST(1 + d7 % 8 AS INT) AS n, CASE d8 % 3 WHEN 0 THEN 'Rx' ELSE 'R' END AS piece FROM puzzles)", select="SELECT id, d13, CASE WHEN d11 = 0 THEN '' ELSE trim(repeat(piece || s2 || ' ', n)) END AS moves, CASE WHEN d10 = 0 THEN 'arbitration by the mask' END AS note, CASE WHEN d9 = 0 THEN 'low' END AS confidence, CASE WHEN d12 < 3 THEN CAST(d12 AS INT) END AS off FROM lines"))
    return rows.withColumn("tier", audit.tier(F.col("moves"), F.col("note"), F.col("confidence"), F.col("off")))


@query(ANCHORED + "SELECT id, tier FROM tiers")
def move_tiers(t):
    return _anchored(t).select("id", "tier")


@query(ANCHORED + "SELECT tier, count(*) FILTER (d13 < 9) AS correct, count(*) AS total, avg(CASE WHEN d13 < 9 THEN 1.0 ELSE 0.0 END) AS share FROM tiers GROUP BY 1")
def tier_calibration(t):
    return audit.calibration(_anchored(t).withColumn("correct", F.col("d13") < 9))


# Review: problems with images, over the logs of repairs and people's answers.
SEEN = PRINTED + """,
known AS (SELECT *, d12 < 3 AS human, d13 < 4 AS fixed, d13 = 4 AS open, d7 > 0 AND (d13 + d12) % 7 <> 0 AS pictured FROM printed)"""


@query(named(oracle(SEEN), """seen AS (SELECT *, CASE WHEN human THEN 'human' WHEN open THEN 'fix:UNRESOLVED' WHEN fixed THEN 'fix:FIXED' ELSE 'original' END AS source,
  CASE WHEN human THEN 'R' || s2 ELSE nullif(moves, '') END AS final, CASE WHEN human THEN 'w' WHEN fixed THEN 'w' WHEN numbered AND NOT blank THEN 'w' ELSE side END AS turn FROM known WHERE pictured)""",
  """judged AS (SELECT *, turn = 'w' AND main_ok AS ok FROM seen)""", select="""
SELECT id, turn AS to_move, source, final AS moves, CASE WHEN final IS NULL THEN 'no-solution' WHEN NOT ok THEN CASE WHEN human THEN 'unsolved' ELSE 'needs-review' END WHEN human THEN 'reviewed' ELSE 'verified' END AS review,
  CASE WHEN final IS NOT NULL AND NOT ok THEN 'R' || s2 END AS breaks_at, CASE WHEN human THEN 'HUMAN' ELSE 'MEDIUM' END AS tier FROM judged"""))
def review_dataset(t):
    return _seen(t).select("id", "to_move", "source", "moves", "review", F.col("breaks_at.san").alias("breaks_at"), "tier")


def _seen(t):
    rows = made(t, named(SEEN, select="SELECT * FROM known"))
    none = "CAST(NULL AS STRING)"
    fixes = rows.where("fixed OR open").selectExpr("k AS _pos", "id", "CASE WHEN open THEN 'UNRESOLVED' ELSE 'FIXED' END AS status", "fen", "CASE WHEN fixed THEN 'w' END AS to_move", f"{none} AS note", f"{none} AS confidence", f"{none} AS fen_fast", f"{none} AS fen_strong")
    people = rows.where("human").selectExpr("k AS _pos", "id", "'ok' AS verdict", "fen", "'w' AS to_move", "'R' || s2 AS moves")
    moved = rows.where("false").selectExpr("k AS _pos", "id", f"{none} AS status", "moves")
    return review.dataset(rows.selectExpr("id", "fen", "side AS to_move"), rows.select("id", "moves"), fixes, moved, people, rows.where("pictured").selectExpr("id", "id || '.png' AS image"))


@query(named(oracle(SEEN), select="SELECT id FROM known WHERE pictured AND NOT human"))
def doubtful_queue(t):
    return review.queue(_seen(t), "doubtful").select("id")


# Boards.
STRUCTURE = f"""CASE WHEN kings_w <> 1 OR kings_b <> 1 THEN 'kings: ' || CAST(kings_w AS STRING) || ' white, ' || CAST(kings_b AS STRING) || ' black'
  WHEN contains(lower(substr(cells, 1, 8) || substr(cells, 57, 8)), 'p') THEN 'pawn on rank 1/8' WHEN pawns_w > 8 OR pawns_b > 8 THEN 'more than 8 pawns' END"""
COUNTED = "SELECT *, " + ", ".join(f"length(cells) - length(replace(cells, '{c}', '')) AS {n}" for c, n in (("K", "kings_w"), ("k", "kings_b"), ("P", "pawns_w"), ("p", "pawns_b"))) + " FROM boards"
RIGHTS = "coalesce(nullif(" + " || ".join(f"CASE WHEN substr(cells, {home + 5}, 1) = '{king}' AND substr(cells, {home + (8 if side in 'Kk' else 1)}, 1) = '{rook}' THEN '{side}' ELSE '' END" for home, king, rook, side in ((56, "K", "R", "K"), (56, "K", "R", "Q"), (0, "k", "r", "k"), (0, "k", "r", "q"))) + ", ''), '-')"


def _boards(t, *columns):
    return made(t, named(BOARDS, select=f"SELECT k, h, cells, {placed('cells')} AS fen FROM boards"))


@query(named(oracle(BOARDS), f"counted AS ({COUNTED})", select=f"SELECT k, {STRUCTURE} AS reason FROM counted"))
def structural_checks(t):
    return _boards(t).select("k", boards.structural_reason(F.col("fen")).alias("reason"))


@query(named(oracle(BOARDS), select=f"SELECT k, cells, {placed('cells')} AS again, {placed('cells')} || ' ' || CASE WHEN k % 3 = 0 THEN 'b' ELSE 'w' END || ' ' || {RIGHTS} || ' - 0 1' AS full_fen FROM boards"))
def board_codec(t):
    cells, turn = boards.decode(F.col("fen")), F.when(F.col("k") % 3 == 0, "b").otherwise("w")
    return _boards(t).select("k", cells.alias("cells"), boards.from_map(boards.to_map(F.col("fen"))).alias("again"), boards.full_fen(F.col("fen"), turn).alias("full_fen"))


# Boards with empty edges: seven letters a row are kept within the middle.
INNER = BOARDS + ", inner_ AS (SELECT k, " + " || ".join(f"CASE WHEN k % 4 = {0 if i == 0 else 1 if i == 7 else 9} THEN '........' ELSE CASE WHEN k % 3 = 0 THEN '.' ELSE substr(cells, {8 * i + 1}, 1) END || substr(cells, {8 * i + 2}, 6) || CASE WHEN k % 5 = 0 THEN '.' ELSE substr(cells, {8 * i + 8}, 1) END END" for i in range(8)) + " AS cells FROM boards)"
ROWS8 = [f"substr(cells, {8 * i + 1}, 8)" for i in range(8)]


def _step(way):
    if way in ("up", "down"):
        return placed("(" + (f"substr(cells, 9, 56) || '........'" if way == "up" else f"'........' || substr(cells, 1, 56)") + ")")
    moved = " || ".join(f"(substr({r}, 2, 7) || '.')" if way == "left" else f"('.' || substr({r}, 1, 7))" for r in ROWS8)
    return placed(f"({moved})")


FREE = {"up": "substr(cells, 1, 8) = '........'", "down": "substr(cells, 57, 8) = '........'", "left": " || ".join(f"substr({r}, 1, 1)" for r in ROWS8) + " = '........'", "right": " || ".join(f"substr({r}, 8, 1)" for r in ROWS8) + " = '........'"}


@query(named(oracle(INNER), select=" UNION ALL ".join(f"SELECT k, '{way}' AS direction, {_step(way)} AS fen FROM inner_ WHERE {free}" for way, free in FREE.items())))
def board_shifts(t):
    rows = made(t, named(INNER, select=f"SELECT k, {placed('cells')} AS fen FROM inner_"))
    return rows.select("k", F.explode(boards.shifts(F.col("fen"))).alias("s")).select("k", "s.direction", "s.fen")


SQUARE_SQL = "substr('abcdefgh', CAST(i % 8 AS INT) + 1, 1) || substr('87654321', CAST(i // 8 AS INT) + 1, 1)"


@query(named(oracle(BOARDS), "squares AS (SELECT i FROM range(0, 64) r(i))", select="""
SELECT k, count(*) FILTER (see <> '?' AND (piece <> '.') <> (see = 'x')) AS off FROM (SELECT k, substr(cells, CAST(i AS INT) + 1, 1) AS piece, translate(substr(md5(h || 'm') || h, CAST(i AS INT) + 1, 1), '0123456789abcdef', 'xxxxx-----------') AS see FROM boards, squares WHERE i < 64) GROUP BY k"""))
def mask_disagreement(t):
    squares = F.array(*map(F.lit, boards.SQUARES))
    seen = F.split(F.expr("translate(md5(h || 'm') || h, '0123456789abcdef', 'xxxxx-----------')"), "")
    names = F.transform(seen, lambda c: F.when(c == "x", "occupied").otherwise("empty"))
    return _boards(t).select("k", boards.mismatches(boards.to_map(F.col("fen")), F.map_from_arrays(squares, names)).cast("long").alias("off"))


@query(named(oracle(BOARDS), "pairs AS (SELECT k, cells, lead(cells) OVER (ORDER BY k) AS other FROM boards)", "squares AS (SELECT i FROM range(0, 64) r(i))", select=f"""
SELECT k, string_agg({SQUARE_SQL}, ' ' ORDER BY i) FILTER (substr(cells, CAST(i AS INT) + 1, 1) <> substr(other, CAST(i AS INT) + 1, 1)) AS squares FROM pairs, squares WHERE other IS NOT NULL GROUP BY k"""))
def board_differences(t):
    """Each board against the next by key; keys of orders are dense, so neighbours meet by their places in runs of keys."""
    rows = _boards(t).select("k", "fen")
    after = rows.select((F.col("k") - 1).alias("k"), F.col("fen").alias("other"))
    both = rows.join(after, "k")
    found = F.array_join(boards.differing(F.array("fen", "other")), " ")
    return both.select("k", F.nullif(found, F.lit("")).alias("squares"))


# Glyph rows: suitable ones have lower case and blanks on light squares.
GLYPH_ROWS = f"""keys AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS STRING)) AS h FROM {{orders}}),
rows_ AS (SELECT k, CAST(1 + k % 8 AS INT) AS rank, {" || ".join(f"CASE WHEN {digit(i + 1)} = 0 THEN 'k' WHEN (k % 8 + 1 + {i} + 1) % 2 = 1 THEN CASE WHEN {digit(i + 9)} < 8 THEN ' ' ELSE 'q' END ELSE CASE WHEN {digit(i + 9)} < 8 THEN '+' ELSE 'R' END END" for i in range(8))} AS cells FROM keys)"""


@query(named(oracle(GLYPH_ROWS), "squares AS (SELECT i FROM range(0, 8) r(i))", select="""
SELECT k, bool_and(CASE c WHEN ' ' THEN light WHEN '+' THEN NOT light ELSE (c = lower(c)) = light END) AS fits FROM (SELECT k, substr(cells, CAST(i AS INT) + 1, 1) AS c, (rank + i + 1) % 2 = 1 AS light FROM rows_, squares) GROUP BY k"""))
def glyph_rows(t):
    rows = made(t, named(GLYPH_ROWS, select="SELECT k, rank, cells FROM rows_"))
    return rows.select("k", boards.row_fits(F.col("rank"), F.split("cells", "")).alias("fits"))


# Texts.
NUMBERED = """words AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS STRING)) AS h, CAST(o_orderkey AS STRING) AS w FROM {orders})"""


@query(named(oracle(NUMBERED), select="SELECT k, CASE k % 4 WHEN 0 THEN 'a' || w || '  b' WHEN 1 THEN '1.e4   e5 ' || w WHEN 2 THEN 'x ' || w || ' y' ELSE 'm ' || w END AS main FROM words"))
def main_line_text(t):
    rows = made(t, named(NUMBERED, select="SELECT k, CASE k % 4 WHEN 0 THEN 'a' || w || ' (v (deep ' || w || ') z) b' WHEN 1 THEN '1.e4 {a (b} (1.d4 {x)} e5) e5 ' || w WHEN 2 THEN ')x} ' || w || ' {n {m} n}y' ELSE 'm ' || w || '(open ' END AS moves FROM words"))
    return rows.select("k", text.main_text(F.col("moves")).alias("main"))


SQ = "substr('abcdefgh', CAST({0} % 8 AS INT) + 1, 1) || CAST(1 + {1} % 8 AS STRING)"
GLUED = NUMBERED + f""", glued AS (SELECT k, {SQ.format(digit(1), digit(2))} AS a, {SQ.format(digit(3), digit(4))} AS b, {SQ.format(digit(5), digit(6))} AS c, substr('KQRBN', CAST({digit(7)} % 5 AS INT) + 1, 1) AS p, k % 3 AS kind FROM words)"""


@query(named(oracle(GLUED), select="""SELECT k, p || a || ' K' || b || CASE kind WHEN 0 THEN ' O-O-O+' WHEN 1 THEN ' ' || c || '=Q#' ELSE ' Nbx' || c END AS moves, CAST(3 AS BIGINT) AS n FROM glued"""))
def main_line_tokens(t):
    rows = made(t, named(GLUED, select="SELECT k, '11.' || p || a || '!?K' || b || ' {not N' || c || '} (12.R' || c || ') 12. ' || CASE kind WHEN 0 THEN 'O-O-O+' WHEN 1 THEN c || '=Q#' ELSE 'Nbx' || c END || ' 1-0' AS moves FROM glued"))
    found = text.tokens(F.col("moves"))
    return rows.select("k", F.array_join(found, " ").alias("moves"), F.size(found).cast("long").alias("n"))


@query(named(oracle(GLUED), select="""SELECT k, CASE k % 4 WHEN 0 THEN '1. ' || a || ' ' || b || ' 2. ' || c WHEN 1 THEN '1... ' || a || ' 2. ' || b || ' ' || c WHEN 2 THEN '1... ' || a ELSE '' END AS moves FROM glued"""))
def rebuilt_text(t):
    rows = made(t, named(GLUED, select="SELECT k, CASE k % 4 WHEN 2 THEN array(a) WHEN 3 THEN array() ELSE array(a, b, c) END AS sans, CASE WHEN k % 4 IN (0, 3) THEN 'w' ELSE 'b' END AS turn FROM glued"))
    return rows.select("k", text.numbered(F.col("sans"), F.col("turn")).alias("moves"))


@query(named(oracle(GLUED), select="""SELECT k, CASE kind WHEN 0 THEN '1.' || a || ' ' || b || ' (1...' || c || ') {n}' WHEN 1 THEN '1.' || a || ' 1-0 (1...' || b || ' (x) y)' ELSE '1.' || a || ' 2. ' || b || ' (1...' || c || ')' END AS moves FROM glued"""))
def book_variations(t):
    rows = made(t, named(GLUED, select="SELECT k, CASE kind WHEN 0 THEN '1.' || a || ' (1...' || c || ') ' || b || ' {n}' WHEN 1 THEN '1.' || a || ' (1...' || b || ' (x) y) 1-0' ELSE '1.' || a || ' (1...' || c || ') 2. ' || b END AS moves FROM glued"))
    return rows.select("k", kernel.shift_variations("moves")["text"].alias("moves"))


@query(named(oracle(GLUED), select="""SELECT k, CASE kind WHEN 0 THEN 'b' WHEN 1 THEN 'w' END AS mover, kind = 2 AS older FROM glued"""))
def movers(t):
    rows = made(t, named(GLUED, select="SELECT k, CASE kind WHEN 0 THEN ' ' || CAST(k AS STRING) || '...K' || a WHEN 1 THEN CAST(k AS STRING) || ' . K' || a ELSE 'S' || a || ' KxP' END AS moves FROM glued"))
    return rows.select("k", text.first_mover(F.col("moves")).alias("mover"), text.is_old_notation(F.col("moves")).alias("older"))


@query(r"SELECT doc_id, regexp_matches(text, '\b[SP][a-h][1-8]\b|\b[KQRBSP]x[KQRBSP]{1,2}\b') AS older, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, md5(replace(replace(replace(text, 'a', 'K'), 'e', 'Q'), 'o', '')) AS lettered FROM documents WHERE text IS NOT NULL")
def sign_tables(t):
    body = F.col("text")
    return t("documents").where("text IS NOT NULL").select("doc_id", text.is_old_notation(body).alias("older"), F.md5(text.xml_escape(body)).alias("escaped"), F.md5(text.figurines(F.translate(body, "aeo", "♔♛♙"))).alias("lettered"))


@query("SELECT doc_id, md5(replace(replace(translate(strip_accents(text), '×‐–—ı', 'x---1'), '!', ''), '?', '')) AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_texts(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.md5(kernel.clean_text("text")["text"]).alias("cleaned"))


@query(named(oracle(GLUED), select="SELECT k, CASE kind WHEN 0 THEN 'S' || a || '(' || b || ') Kx' || c WHEN 1 THEN 'P' || a || ' castles' ELSE 'K' || c END AS words FROM glued"))
def older_words(t):
    rows = made(t, named(GLUED, select="SELECT k, CASE kind WHEN 0 THEN '1. S' || a || '! (' || b || ') *2 Kx' || c WHEN 1 THEN '4.P' || a || ', castles; threat 5.Q' || c ELSE 'K' || c || ' (threat Q' || a || ')' || chr(10) || 'R' || b END AS moves FROM glued"))
    return rows.select("k", F.array_join(kernel.old_tokens("moves")["tokens"], " ").alias("words"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_custkey AS STRING) END AS id, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderkey % 7 AS BIGINT) END AS n FROM orders")
def json_in_replies(t):
    rows = made(t, """SELECT o_orderkey AS k, 'Here it is: ' || chr(10) || CASE o_orderkey % 5 WHEN 0 THEN '{bad' WHEN 1 THEN 'nothing' ELSE '{"id": "' || CAST(o_custkey AS STRING) || '", "n": ' || CAST(o_orderkey % 7 AS STRING) || '} ok' END AS reply FROM {orders}""")
    found = text.json_inside(F.col("reply"), "id string, n bigint")
    return rows.select("k", found["id"].alias("id"), found["n"].alias("n"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 < 2 THEN 'White ' || CAST(c_custkey AS STRING) END AS white, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment ELSE 'Study by ' || c_mktsegment END AS black,
  CASE WHEN c_custkey % 3 = 0 THEN 'Town' END AS site, CASE WHEN c_custkey % 3 = 0 THEN CAST(1900 + c_custkey % 100 AS STRING) || '.??.??' END AS date FROM customer""")
def attributions(t):
    rows = made(t, "SELECT c_custkey AS k, CAST(c_custkey AS STRING) || ' ' || CASE c_custkey % 3 WHEN 0 THEN 'White ' || CAST(c_custkey AS STRING) || '-' || c_mktsegment || ', Town ' || CAST(1900 + c_custkey % 100 AS STRING) WHEN 1 THEN 'White ' || CAST(c_custkey AS STRING) || ' - ' || c_mktsegment ELSE 'Study by ' || c_mktsegment END AS id FROM {customer}")
    return rows.select("k", text.game_headers(text.attribution(F.col("id"))).alias("g")).select("k", "g.white", "g.black", "g.site", "g.date")


# Replies of a model about one diagram.
@query(named(oracle(PUZZLES), select="SELECT id, CAST(k AS BIGINT) AS number, CASE WHEN d7 < 8 THEN 'w' ELSE 'b' END AS to_move, CASE WHEN d8 < 8 THEN 'mate in ' || CAST(d9 AS STRING) END AS hint, fen AS listed, CASE WHEN d10 < 8 THEN replace(fen, 'R', 'q') ELSE '7k/8/8/8/8/8/8/7K' END AS patched, CASE WHEN d7 < 8 THEN 'w' ELSE 'b' END AS caption FROM puzzles"))
def replies(t):
    rows = made(t, named(PUZZLES, select="""SELECT id, 'HEADER: number ' || id || ', ' || CASE WHEN d7 < 8 THEN 'White' ELSE 'black' END || chr(10) || CASE WHEN d8 < 8 THEN 'HINT: mate in ' || CAST(d9 AS STRING) || chr(10) ELSE '' END || s1 || ': white pawn' || chr(10) || 'h8 - BLACK king' || chr(10) || 'h1: white King' || chr(10) || upper(s1) || ': White Rook' || chr(10) || 'Caption: ' || CASE WHEN d7 < 8 THEN 'white' ELSE 'Black' END || ' to play' AS reply,
  s1 || CASE WHEN d10 < 8 THEN ': black queen' ELSE ': EMPTY' END AS closer FROM puzzles"""))
    head, board = text.reply_header(F.col("reply")), text.listing(F.col("reply"))
    return rows.select("id", head.alias("x"), boards.from_map(board).alias("listed"), boards.from_map(text.patched(board, F.col("closer"))).alias("patched"), text.caption(F.col("reply")).alias("caption")).select("id", F.col("x.number").cast("long").alias("number"), "x.to_move", "x.hint", "listed", "patched", "caption")


def _after(f: str, r: str, king: str) -> str:
    """The board with the rook on a file and row and the black king in a row of its own."""
    return f"'{king}/' || " + " || '/' || ".join(f"CASE WHEN {r} = {i} THEN (CASE WHEN {f} = 0 THEN '' ELSE CAST({f} AS STRING) END) || 'R' || CAST(7 - {f} AS STRING) ELSE '8' END" for i in range(7, 1, -1)) + " || '/7K'"


PLIES = f"""
SELECT id, CAST(1 AS INTEGER) AS ply, 'R' || s2 AS token, CASE WHEN go12 THEN 'R' || s2 END AS san, CASE WHEN go12 THEN {_after('f2', 'r2', '7k')} || ' b - - 1 1' END AS board, CAST(CASE WHEN go12 THEN 1 ELSE 0 END AS INTEGER) AS options FROM puzzles
UNION ALL SELECT id, 2, 'Kg8', 'Kg8', {_after('f2', 'r2', '6k1')} || ' w - - 2 2', 1 FROM puzzles WHERE go12
UNION ALL SELECT id, 3, 'R' || s3, CASE WHEN go23 THEN 'R' || s3 END, CASE WHEN go23 THEN {_after('f3', 'r3', '6k1')} || ' b - - 3 2' END, CASE WHEN go23 THEN 1 ELSE 0 END FROM puzzles WHERE go12"""


@query(named(oracle(PUZZLES), select=PLIES))
def plies(t):
    """A row for each ply of each line, by a lateral join with the table function."""
    from boardframe.kernel.plies import with_plies

    rows = made(t, named(PUZZLES, select="SELECT id, fen, 'w' AS turn, '1.R' || s2 || ' Kg8 2.R' || s3 AS moves FROM puzzles"))
    return with_plies(rows).select("id", "ply", "token", "san", "board", "options")


@query(named(oracle(PUZZLES), select=PLIES))
def plies_in_sql(t):
    """The same in SQL."""
    from boardframe.kernel.plies import register

    rows = made(t, named(PUZZLES, select="SELECT id, fen, '1.R' || s2 || ' Kg8 2.R' || s3 AS moves FROM puzzles"))
    register(rows.sparkSession)
    rows.createOrReplaceTempView("lines_of_puzzles")
    return rows.sparkSession.sql("SELECT id, p.* FROM lines_of_puzzles, LATERAL plies(fen, 'w', moves) AS p")

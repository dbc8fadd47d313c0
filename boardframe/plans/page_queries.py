"""Queries of the operators on logs, overlays, running text and pages, over rows generated from the driver's tables.

Pages and texts are built from known parts, so the oracle knows what must be read from them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from boardframe.functions import boards
from boardframe.operators import entries, export, layout, overlay, review, sequences, state
from boardframe.plans.catalogue import query
from boardframe.plans.generated import PUZZLES, dealt, digit, few, made, named, oracle
from boardframe.sources import files
from boardframe.sources.pages import PdfPages

# Logs.
FIXES = """fixes AS (SELECT event_id AS _pos, CAST(user_id AS STRING) AS id, CASE event_type WHEN 'click' THEN 'FIXED' WHEN 'view' THEN 'UNRESOLVED' ELSE 'MOVES_SUSPECT' END AS status, 'f' || CAST(event_id AS STRING) AS fen, CASE WHEN event_id % 3 = 0 THEN 'b' END AS to_move FROM {events})"""
MOVES = """repairs AS (SELECT event_id AS _pos, CAST(user_id AS STRING) AS id, CASE WHEN event_id % 2 = 0 THEN 'REPAIRED' ELSE 'UNREPAIRED' END AS status, '1. m' || CAST(event_id AS STRING) AS moves FROM {events} WHERE event_type = 'purchase')"""
PEOPLE = """people AS (SELECT event_id AS _pos, CAST(user_id AS STRING) AS id, CASE WHEN event_id % 4 < 2 THEN 'ok' WHEN event_id % 4 = 2 THEN 'fixed' ELSE 'exclude' END AS verdict, CASE WHEN event_id % 4 = 2 THEN 'h' || CAST(event_id AS STRING) ELSE '' END AS fen, CASE WHEN event_id % 8 = 0 THEN 'b' END AS to_move, CASE WHEN event_id % 4 = 2 THEN '1... h' || CAST(event_id AS STRING) END AS moves FROM {events} WHERE event_type = 'signup')"""
PRINTS = """prints AS (SELECT o_orderkey AS _pos, CAST(o_custkey AS STRING) || ' Name ' || CAST(o_orderkey AS STRING) AS id, '2...s' || CAST(o_orderkey AS STRING) AS moves, CAST(o_custkey AS STRING) AS key FROM {orders})"""
OWN = """own AS (SELECT CAST(c_custkey AS STRING) || repeat('*', CAST(c_custkey % 4 AS INT)) AS printed, CAST(c_custkey AS STRING) AS id, 'p' || CAST(c_custkey AS STRING) || ' w' AS fen, CASE WHEN c_custkey % 2 = 0 THEN 'b' END AS to_move, c_name AS hint, c_custkey % 3 <> 0 AS pictured, c_custkey % 4 AS stars FROM {customer})"""


def _latest(table: str, where: str = "true", order: str = "_pos DESC", key: str = "id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM {table} WHERE {where}) WHERE place = 1)"


@query(named(*map(oracle, (FIXES, MOVES, PEOPLE, PRINTS, OWN)), select=f"""
SELECT o.id, CASE WHEN o.pictured THEN o.printed || '.png' END AS image, CASE WHEN h.verdict = 'fixed' THEN h.fen WHEN f.fen IS NOT NULL THEN f.fen ELSE 'p' || o.id END AS fen,
  coalesce(CASE WHEN h.verdict <> 'exclude' THEN h.to_move END, f.to_move, CASE WHEN m.moves IS NOT NULL THEN 'w' WHEN s.moves IS NOT NULL THEN 'b' END, o.to_move, 'w') AS to_move,
  coalesce(CASE WHEN h.verdict <> 'exclude' THEN h.moves END, m.moves, s.moves) AS moves, CASE WHEN h.verdict = 'exclude' THEN 'excluded' WHEN h.verdict IS NOT NULL THEN 'approved' ELSE 'recognized' END AS status,
  CAST(o.stars AS BIGINT) AS difficulty, 'Name ' || CAST(n._pos AS STRING) AS game_name, CASE WHEN h.verdict <> 'exclude' THEN 'human' WHEN f.fen IS NOT NULL THEN 'recognize:' || f.status ELSE 'original' END AS fen_source,
  CASE WHEN h.verdict <> 'exclude' AND h.moves IS NOT NULL THEN 'human' WHEN m.moves IS NOT NULL THEN 'repair:REPAIRED' ELSE 'original' END AS moves_source
FROM own o LEFT JOIN {_latest('prints', order='_pos', key='key')} s ON s.key = o.id LEFT JOIN {_latest('prints', key='key')} n ON n.key = o.id LEFT JOIN {_latest('fixes', "status IN ('FIXED', 'MOVES_SUSPECT')")} f ON f.id = o.id
  LEFT JOIN {_latest('repairs', "status = 'REPAIRED'")} m ON m.id = o.id LEFT JOIN {_latest('people')} h ON h.id = o.id"""))
def book_import(t):
    own = made(t, named(OWN, select="SELECT * FROM own"))
    rows = overlay.import_state(
        own.select(F.col("printed").alias("id"), "fen", "to_move", "hint"),
        made(t, named(PRINTS, select="SELECT _pos, id, moves FROM prints")),
        made(t, named(FIXES, select="SELECT * FROM fixes")),
        made(t, named(MOVES, select="SELECT * FROM repairs")),
        made(t, named(PEOPLE, select="SELECT * FROM people")),
        own.where("pictured").selectExpr("id", "printed || '.png' AS image"),
    )
    return rows.select("id", "image", "fen", "to_move", "moves", "status", F.col("difficulty").cast("long").alias("difficulty"), "game_name", F.col("sources.fen").alias("fen_source"), F.col("sources.moves").alias("moves_source"))


@query(named(*map(oracle, (FIXES, MOVES, PEOPLE)), select=f"""
SELECT 'fixes' AS log, status, count(*) AS n FROM {_latest('fixes')} GROUP BY 2 UNION ALL SELECT 'people', verdict, count(*) FROM {_latest('people')} GROUP BY 2 UNION ALL SELECT 'repairs', status, count(*) FROM {_latest('repairs')} GROUP BY 2"""))
def log_report(t):
    return export.report({name: made(t, named(sql, select=f"SELECT * FROM {name}")) for name, sql in (("fixes", FIXES), ("people", PEOPLE), ("repairs", MOVES))})


@query(named(oracle(FIXES), select=f"SELECT id, _pos AS pos FROM {_latest('fixes')} WHERE status IN ('FIXED', 'MOVES_SUSPECT')"))
def buried_fixes(t):
    return state.latest_accepted(made(t, named(FIXES, select="SELECT * FROM fixes")), state.ACCEPTED_FENS, buried=True).select("id", F.col("_pos").alias("pos"))


@query(named(*map(oracle, (FIXES, OWN)), select="SELECT id FROM own WHERE id NOT IN (SELECT id FROM fixes WHERE status <> 'UNRESOLVED')"))
def resumed_targets(t):
    done = made(t, named(FIXES, select="SELECT * FROM fixes"))
    return state.without_done(made(t, named(OWN, select="SELECT id FROM own")), done, retry=F.col("status") == "UNRESOLVED")


@query(named(oracle(OWN), select="SELECT id, 'verify' AS stage, CASE WHEN stars > 1 THEN 'GOOD' ELSE 'BAD' END AS verdict, left(repeat(hint, 25), 300) AS detail, CAST(2 AS BIGINT) AS n FROM own"))
def ledgers(t):
    rows = made(t, named(OWN, select="SELECT id, hint, stars FROM own"))
    first = state.with_entry(F.lit(None).cast("array<struct<stage:string,verdict:string,detail:string>>"), "import", F.lit("LEGACY"), F.lit(None).cast("string"))
    both = state.with_entry(first, "verify", F.when(F.col("stars") > 1, "GOOD").otherwise("BAD"), F.repeat("hint", F.lit(25)))
    return rows.select("id", both.alias("l")).select("id", F.element_at("l", -1).alias("e"), F.size("l").cast("long").alias("n")).select("id", "e.*", "n")


@query("SELECT o_custkey, o_orderkey, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def repeated_keys(t):
    return sequences.repeated(t("orders").select("o_custkey", "o_orderkey"), "o_custkey")


QUEUE = PUZZLES + """, queued AS (SELECT id, k, CASE d7 % 5 WHEN 0 THEN 'needs-review' WHEN 1 THEN 'unsolved' WHEN 2 THEN 'no-solution' WHEN 3 THEN 'verified' ELSE 'reviewed' END AS review, d7 % 5 + 1 AS priority, CASE WHEN d8 < 5 THEN 'LOW' WHEN d8 < 10 THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM puzzles)"""


@query(named(oracle(QUEUE), select="SELECT id, 'doubtful' AS wanted FROM queued WHERE tier <> 'HIGH' UNION ALL SELECT id, 'unsolved' FROM queued WHERE review = 'unsolved' UNION ALL SELECT id, 'all' FROM queued"))
def queue_filters(t):
    rows = made(t, named(QUEUE, select="SELECT * FROM queued"))
    parts = [review.queue(rows, wanted).select("id", F.lit(wanted).alias("wanted")) for wanted in ("doubtful", "unsolved", "all")]
    return parts[0].union(parts[1]).union(parts[2])


# Solutions over pages, by conversation: turns are pages, every third has no solutions.
PAGED = """paged AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0 ELSE 2 END AS n, CASE WHEN turn % 2 = 1 THEN 'c' || CAST(turn AS STRING) END AS more FROM {conversations})"""


@query(named(oracle(PAGED), """owned AS (SELECT conv_id, turn, more, (SELECT max(p.turn) FROM paged p WHERE p.conv_id = x.conv_id AND p.turn < x.turn AND p.n > 0) AS owner FROM paged x)""", """tails AS (SELECT conv_id, owner AS turn, string_agg(more, ' ' ORDER BY turn) AS more FROM owned WHERE owner IS NOT NULL AND more IS NOT NULL GROUP BY 1, 2)""", select="""
SELECT conv_id, turn, CAST(0 AS BIGINT) AS place, CAST(turn AS STRING) || 'a' AS id, 'm' AS moves FROM paged WHERE n > 0 UNION ALL
SELECT p.conv_id, p.turn, 1, CAST(p.turn AS STRING) || 'b', 'n' || CASE WHEN more IS NULL THEN '' ELSE ' ' || more END FROM (SELECT conv_id, turn, n FROM paged) p LEFT JOIN tails USING (conv_id, turn) WHERE n > 0"""))
def stitched_pages(t):
    rows = made(t, named(PAGED, select="SELECT conv_id, turn, CASE WHEN n = 0 THEN array() ELSE array(named_struct('id', 'Position ' || CAST(turn AS STRING) || 'a', 'moves', 'm'), named_struct('id', CAST(turn AS STRING) || 'b', 'moves', 'n')) END AS solutions, more AS continuation FROM paged"))
    return sequences.stitch_pages(rows, "turn", ["conv_id"]).withColumn("place", F.col("place").cast("long"))


# Running text: three entries for each customer, with false headers, furniture, titles, quotations and lines of names between.
ENTRY_LINES = [
    ("Bold", 9, "'2. Not – Yet'"), ("Bold", 30, "'Part ' || k"), ("Bold", 9, "'1. Ann' || k || ' – Bob, Oslo ' || k"), ("Bold", 9, "'♘f3 '"), ("Roman", 9, "'is ' || k"), ("BoldItalic", 9, "'He said ' || k"), ("Roman", 9, "'Page ' || k"), ("Tick", 9, "'x'"),
    ("Bold", 9, "'Some Name'"), ("Bold", 9, "'4. Too – Far'"), ("Bold", 9, "'2. Cy' || k || ' – Dan'"), ("Roman", 9, "'text  of ' || k"), ("Bold", 9, "'3. Last'"), ("Bold", 9, "'e4 John Smith'"),
]
SPANS = "keys AS (SELECT CAST(c_custkey AS STRING) AS k FROM {customer}), spans AS (" + " UNION ALL ".join(f"SELECT k AS doc, {i // 5} AS page, {i - (i == 4)} AS line, {1 if i == 4 else 0} AS seq, '{font}' AS font, {size} AS size, {body} AS text FROM keys" for i, (font, size, body) in enumerate(ENTRY_LINES)) + ")"


@query("""SELECT k AS doc, CAST(n AS BIGINT) AS number, CASE n WHEN 1 THEN 'Ann' || k WHEN 2 THEN 'Cy' || k ELSE 'Last' END AS white, CASE n WHEN 1 THEN 'Bob' WHEN 2 THEN 'Dan' ELSE '' END AS black, CASE n WHEN 1 THEN 'Oslo ' || k ELSE '' END AS event,
  CASE n WHEN 1 THEN 'Nf3 4. Too – Far' WHEN 2 THEN '' ELSE 'e4' END AS main, CASE n WHEN 1 THEN 'Nf3 is ' || k || ' 4. Too – Far' WHEN 2 THEN 'text of ' || k ELSE 'e4 John Smith' END AS text
FROM (SELECT CAST(c_custkey AS STRING) AS k FROM customer), (VALUES (1), (2), (3)) v(n)""")
def text_entries(t):
    return entries.entries(made(t, named(SPANS, select="SELECT * FROM spans")), exclude_fonts=["Tick"], furniture=[r"Page \d+$"], max_size=20)


@query(oracle("SELECT CAST(c_custkey AS BIGINT) AS number, CAST((c_custkey - 1) // 6 + 1 AS BIGINT) AS page, CAST((c_custkey - 1) % 2 AS BIGINT) AS \"column\", CAST((c_custkey - 1) % 6 // 2 AS BIGINT) AS row, CAST((c_custkey - 1) // 34 + 1 AS BIGINT) AS solution_page FROM {customer} WHERE c_custkey > 0"))
def sample_places(t):
    found = entries.sample_places(t("customer").where("c_custkey > 0").select(F.col("c_custkey").alias("number")))
    return found.select("number", *(F.col(c).cast("long").alias(c) for c in ("page", "column", "row", "solution_page")))


@query("SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS num, CAST(floor(l_quantity * 2) AS BIGINT) AS \"left\", CAST(floor(l_tax * 100 * 2) AS BIGINT) AS top, CAST(floor(l_quantity * 4) AS BIGINT) AS \"right\", CAST(floor(l_discount * 100 * 2) AS BIGINT) AS bottom FROM (SELECT l_orderkey, l_linenumber, l_quantity, round(l_tax * 100) / 100 AS l_tax, round(l_discount * 100) / 100 AS l_discount FROM lineitem)")
def crop_boxes(t):
    cells = t("lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS num", "'w' AS side", "l_quantity AS x0", "round(l_tax * 100) / 100 * 100 AS y0", "l_quantity * 2 AS x1", "round(l_discount * 100) / 100 * 100 AS y1")
    return entries.crops(cells, 2.0).select("page", *(F.col(c).cast("long").alias(c) for c in ("num", "left", "top", "right", "bottom")))


# Pages of six diagrams in two columns: anchors, printed numbers (some lost or misread), side marks (some double), a board in glyphs.
LAYOUT = layout.Layout((18, 25), 0.5, (-2, -30, 120), "Marks", {"x": "b", "y": "w"}, "Merida")
PLACES = f"""keys AS (SELECT s_suppkey AS p, md5(CAST(s_suppkey AS STRING)) AS h FROM {{supplier}}),
six AS (SELECT p, h, n FROM keys, (VALUES (0), (1), (2), (3), (4), (5)) v(n)),
diagrams AS (SELECT p, h, n, CASE WHEN n < 3 THEN 50.0 ELSE 300.0 END + (p % 3) AS x0, 100.0 + 150 * (n % 3) AS y0, 100 * p + n AS num, CASE n WHEN 0 THEN {digit(1)} WHEN 1 THEN {digit(2)} WHEN 2 THEN {digit(3)} WHEN 3 THEN {digit(4)} WHEN 4 THEN {digit(5)} ELSE {digit(6)} END AS d FROM six)"""
#: A misread number counts only where most agree; on every seventh page none is printed.
PRINTED_NUMBERS = PLACES + ", printed AS (SELECT *, CASE WHEN p % 7 = 0 OR (d < 4 AND n > 2) THEN NULL WHEN d >= 14 AND n > 2 THEN num + 7 ELSE num END AS shown FROM diagrams)"


@query(named(oracle(PRINTED_NUMBERS), select="""
SELECT p AS page, CAST(n AS BIGINT) AS place, CASE WHEN p % 7 > 0 THEN CAST(num AS BIGINT) END AS num, CAST(x0 - 2 AS DOUBLE) AS x0, CAST(CASE WHEN n < 3 THEN 300.0 + (p % 3) - 2 ELSE 500.0 - 50 - (p % 3) END AS DOUBLE) AS x1, CASE WHEN d % 4 = 0 THEN NULL WHEN d % 4 = 1 THEN 'b' WHEN d % 4 = 2 THEN 'w' END AS side,
  CASE WHEN p % 7 = 0 THEN 'no printed number' WHEN shown IS NULL OR shown <> num THEN 'number corrected' END AS problem FROM printed"""))
def page_cells(t):
    return _cells(t).select("page", F.col("place").cast("long").alias("place"), F.col("num").cast("long").alias("num"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "side", "problem")


def _cells(t):
    rows = made(t, named(PRINTED_NUMBERS, select="SELECT p AS page, n, d, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, shown FROM printed"))
    drawn = rows.selectExpr("page", "x0", "y0", "x0 + 20 AS x1", "y0 + 20 AS y1", "4 AS items").union(rows.selectExpr("page", "x0 + 1", "y0 + 1", "x0 + 91", "y0 + 91", "4")).union(rows.selectExpr("page", "x0 + 3", "y0 + 3", "x0 + 23", "y0 + 23", "9"))
    found = layout.anchors(drawn, LAYOUT)
    # Marks: one drawn twice, one once, two of different sides.
    marks = [("d % 4 = 1", "x", 5.0, 0), ("d % 4 = 1", "x", 5.2, 1), ("d % 4 = 2", "y", 5.0, 2), ("d % 4 = 3", "x", 5.0, 3), ("d % 4 = 3", "y", 15.0, 4), ("d % 4 = 0", "z", 5.0, 5)]
    glyphs = [rows.where(where).selectExpr("page", f"n * 10 + {seq} AS seq", f"x0 + {dx} AS x0", "y0 + 10 AS y0", "'Marks' AS font", f"'{ch}' AS ch") for where, ch, dx, seq in marks]
    all_ = glyphs[0]
    for more in glyphs[1:]:
        all_ = all_.union(more)
    numbers = rows.where("shown IS NOT NULL").select("page", "x0", "y0", F.col("shown").alias("printed"))
    pages = rows.select("page").distinct().withColumn("width", F.lit(1000.0 / 2))
    return layout.cells(found, numbers, layout.side_marks(all_, LAYOUT), pages, LAYOUT)


# Boards in a diagram font: light squares in lower case. Two layers differ by the white rook; the last drawn counts, unless it lacks a row.
FONT = {v: k for k, v in layout.GLYPHS.items()}
GLYPH_LINES = 'lines AS (SELECT i AS r FROM (VALUES (8), (7), (6), (5), (4), (3), (2), (1)) v(i)), files AS (SELECT i AS f FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(i)), layers AS (SELECT i AS layer FROM (VALUES (0), (1)) v(i))'
SET_BOARDS = PUZZLES + ", " + GLYPH_LINES + """, squares AS (SELECT k, d7, layer, r, f, CASE WHEN r = 8 AND f = 7 THEN 'k' WHEN r = 1 AND f = 7 THEN 'K' WHEN layer = 0 AND f = f1 AND r = r1 OR layer = 1 AND f = f2 AND r = r2 THEN 'R' ELSE '.' END AS piece, (r + f) % 2 = 0 AS light FROM puzzles, lines, files, layers)"""


@query(named(oracle(PUZZLES), select="""SELECT k AS page, CASE WHEN d7 > 0 THEN CASE WHEN d7 < 8 THEN fen ELSE second END || ' w - - 0 1' WHEN d7 = 0 THEN fen || ' w - - 0 1' END AS fen, CAST(NULL AS STRING) AS error FROM (SELECT *, '7k/' || """ + " || '/' || ".join(f"CASE WHEN r2 = {r} THEN (CASE WHEN f2 = 0 THEN '' ELSE CAST(f2 AS STRING) END) || 'R' || CAST(7 - f2 AS STRING) ELSE '8' END" for r in range(7, 1, -1)) + " || '/7K' AS second FROM puzzles)"))
def font_boards(t):
    """The second layer lacks a row where d7 is below 8."""
    rows = made(t, named(SET_BOARDS, select="SELECT k, d7, layer, r, f, piece, light FROM squares WHERE NOT (layer = 1 AND d7 < 8 AND r = 4)"))
    codes = F.create_map(*(F.lit(x) for pair in FONT.items() for x in pair))
    letter = F.when(F.col("piece") == ".", F.when(F.col("light"), " ").otherwise("+")).otherwise(F.when(F.col("light"), codes[F.col("piece")]).otherwise(F.upper(codes[F.col("piece")])))
    square = rows.select(F.col("k").alias("page"), (F.col("layer") * 100 + (8 - F.col("r")) * 10 + F.col("f") + 1).alias("seq"), (60.0 + 5 * F.col("f") + 5).alias("x0"), (90.0 + 12 * (8 - F.col("r"))).alias("y0"), F.lit("Chess Merida").alias("font"), F.col("layer").alias("color"), letter.alias("ch"))
    label = rows.where("f = 0").select(F.col("k").alias("page"), (F.col("layer") * 100 + (8 - F.col("r")) * 10).alias("seq"), F.lit(60.0).alias("x0"), (90.0 + 12 * (8 - F.col("r"))).alias("y0"), F.lit("Chess Merida").alias("font"), F.col("layer").alias("color"), F.char(F.lit(0xC0 - 1) + F.col("r")).alias("ch"))
    cells = rows.select(F.col("k").alias("page")).distinct().selectExpr("page", "0 AS place", "50D AS x0", "80D AS y0", "200D AS x1", "200D AS y1")
    return layout.font_boards(square.union(label), cells, LAYOUT).select("page", "fen", "error")


@query(named(oracle(PRINTED_NUMBERS), select="""
SELECT count(*) AS pages, round(avg(CASE WHEN p % 7 > 0 THEN 1.0 ELSE 0.0 END), 3) AS text_fraction, CAST(6 * count(*) FILTER (p % 7 > 0) AS BIGINT) AS total_chars, count(*) FILTER (p % 7 = 0 AND p % 2 = 0) AS scanned_pages, avg(CASE WHEN p % 7 > 0 THEN 1.0 ELSE 0.0 END) > 0.5 AS born_digital,
  list(p ORDER BY p) FILTER (p % 3 > 0) AS anchor_pages, 'Sym' AS diagram_font FROM keys"""))
def page_profile(t):
    rows = made(t, named(PRINTED_NUMBERS, select="SELECT p AS page, n FROM printed"))
    glyphs = rows.where("page % 7 > 0").select("page", F.when(F.col("n") == 0, "Sym").otherwise("Roman").alias("font"), F.when(F.col("n") == 0, F.lit("")).otherwise("a").alias("ch"))
    found = layout.profile(glyphs, rows.where("page % 3 > 0").select("page"), rows.where("n = 0 AND page % 2 = 0").select("page"), rows.select("page"))
    return found.select("pages", "text_fraction", "total_chars", "scanned_pages", "born_digital", "anchor_pages", F.col("diagram_fonts")[0]["font"].alias("diagram_font"))


# Pictures of boards with the puzzle's three pieces as blots; some have a smudge that is neither blank nor a piece, some no frame.
def _pictures(t):
    rows = made(t, named(PUZZLES, select="SELECT id, fen, CAST(f2 AS INT) AS f, CAST(r2 AS INT) AS r, d7 FROM puzzles"))

    def draw(batches):
        for part in few(batches):
            out = []
            for fen, f, r, d in zip(part["fen"], part["f"], part["r"], part["d7"], strict=True):
                image = np.full((180, 180), 255, np.uint8)
                if d > 0:
                    for k in (8, 169):
                        image[8:170, k - 1 : k + 2] = image[k - 1 : k + 2, 8:170] = 0
                at = 0
                for c in fen.replace("/", ""):
                    if c.isdigit():
                        at += int(c)
                        continue
                    y, x = 10 + at // 8 * 20, 10 + at % 8 * 20
                    image[y + 5 : y + 14, x + 5 : x + 14] = 0
                    at += 1
                if d > 7:
                    y, x = 10 + (8 - r) * 20, 10 + f * 20
                    image[y + 7 : y + 13, x + 8 : x + 11] = 0
                out.append(image.tobytes())
            yield pd.DataFrame({"id": part["id"], "fen": part["fen"], "height": 180, "width": 180, "pixels": out})

    return rows.mapInPandas(draw, "id string, fen string, height int, width int, pixels binary")


@query(named(oracle(PUZZLES), select="""SELECT id, CASE WHEN d7 > 0 THEN 3 END AS occupied, CASE WHEN d7 > 0 THEN CASE WHEN d7 > 7 AND s1 <> s2 THEN 1 ELSE 0 END END AS uncertain, CASE WHEN d7 > 0 THEN 0 END AS off FROM puzzles"""))
def occupancy_masks(t):
    pictures = _pictures(t)
    found = layout.masks(pictures).join(made(t, named(PUZZLES, select="SELECT id, fen FROM puzzles")), "id")
    count = lambda what: F.size(F.map_filter("mask", lambda _, v: v == what))
    return found.select("id", count("occupied").alias("occupied"), count("uncertain").alias("uncertain"), boards.mismatches(boards.to_map(F.col("fen")), F.col("mask")).alias("off"))


@query(named(oracle(PUZZLES), select="""SELECT count(*) FILTER (d7 > 0) AS boards, count(*) FILTER (d7 = 0) AS no_board, CAST(64 * count(*) FILTER (d7 > 0) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS wrong, count(*) FILTER (d7 > 7 AND s1 <> s2) AS uncertain, count(*) FILTER (d7 > 0) AS perfect FROM puzzles"""))
def mask_quality(t):
    pictures = _pictures(t)
    truth = made(t, named(PUZZLES, select="SELECT id, fen FROM puzzles"))
    total, _ = layout.mask_quality(layout.masks(pictures), truth)
    return total.select("boards", "no_board", F.col("cells").cast("long").alias("cells"), F.col("wrong").cast("long").alias("wrong"), F.col("uncertain").cast("long").alias("uncertain"), "perfect")


# Scanned pages with bordered boards: one to three in the left column, one in the right; on some a border is broken off. On all of them there are
# lines of text, a small box and hatching in the boards, on every seventh nothing else.
def _scans(t):
    rows = dealt(t("supplier").select("s_suppkey")).selectExpr("s_suppkey AS page", "CAST(s_suppkey % 3 AS INT) AS n", "s_suppkey % 5 = 0 AS broken", "s_suppkey % 7 = 0 AS bare")

    def draw(batches):
        for part in few(batches):
            out = []
            for n, broken, bare in zip(part["n"], part["broken"], part["bare"], strict=True):
                image = np.full((240, 160), 255, np.uint8)
                for y in (*range(222, 238, 5), 90, 96):  # letters, with gaps between them
                    image[y : y + 3, 84:156] = np.where(np.arange(72) % 6 < 4, 0, 255)
                image[110, 90:121] = image[140, 90:121] = image[110:141, 90] = image[110:141, 120] = 0
                for top, left in [] if bare else [(10 + 70 * i, 10) for i in range(n + 1)] + [(20, 95)]:
                    for k in range(0, 24, 4):  # hatching
                        image[top + 10 + np.arange(20), left + 10 + k + np.arange(20) % 4] = 0
                    image[top : top + 3, left : left + 51] = image[top + 50 : top + 53, left : left + 51] = 0
                    image[top : top + 53, left] = image[top : top + 53, left + 50] = 0
                if broken and not bare:
                    image[70:73, 95:146] = 255
                out.append(image.tobytes())
            yield pd.DataFrame({"page": part["page"], "height": 240, "width": 160, "pixels": out})

    return rows.mapInPandas(draw, "page long, height int, width int, pixels binary")


@query("""
SELECT s_suppkey AS page, CAST(0 AS BIGINT) AS "column", CAST(i AS BIGINT) AS place, CAST(11 + 70 * i AS BIGINT) AS top, CAST(10 AS BIGINT) AS "left", CAST(61 + 70 * i AS BIGINT) AS bottom, CAST(60 AS BIGINT) AS "right", CAST(NULL AS STRING) AS error FROM supplier, range(0, 3) r(i) WHERE i <= s_suppkey % 3 AND s_suppkey % 7 > 0
UNION ALL SELECT s_suppkey, 1, 0, 21, 95, 71, 145, NULL FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 UNION ALL SELECT s_suppkey, 1, NULL, NULL, NULL, NULL, NULL, '1 border rows' FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 7 > 0""")
def bordered_boards(t):
    book = layout.Layout.load({"detect_zoom": 1.0, "ink_threshold": 160, "min_border_run": 45, "expected_ids": [1, 9]})
    found = layout.bordered_boards(layout.pixel_runs(_scans(t), ink=book.ink), book.min_border_run * book.zoom)
    return found.select("page", *(F.col(c).cast("long").alias(c) for c in ("column", "place", "top", "left", "bottom", "right")), "error")


@query("""
SELECT CAST(c_custkey AS BIGINT) AS num, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 4 > 0 THEN 'b' END WHEN c_custkey % 2 = 0 THEN 'w' END AS side FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0""")
def kept_sides(t):
    """Sides of a run over pages, some read twice, over those of an earlier run."""
    rows = t("customer").select(F.col("c_custkey").alias("num"))
    known = rows.where("num % 2 = 0").select("num", F.lit("w").alias("side"))
    cells = rows.where("num % 3 > 0").select(F.lit(2).alias("page"), F.lit(0).alias("place"), "num", F.expr("CASE WHEN num % 4 > 0 THEN 'b' END").alias("side"))
    earlier = cells.withColumns({"page": F.lit(1), "side": F.lit("w")}).union(rows.select(F.lit(9), F.lit(0), F.lit(None).cast("long"), F.lit("w")))
    return entries.merged_sides(cells.union(earlier), known).select(F.col("num").cast("long").alias("num"), "side")


@query(named(oracle(PUZZLES), select="SELECT id, CAST(1 AS BIGINT) AS wrong FROM puzzles WHERE d7 > 0 AND s1 <> s2 ORDER BY id DESC LIMIT 8"))
def worst_boards(t):
    """The boards whose masks have most wrong squares: the truth has a piece more than the picture, where some pictures have a smudge."""
    pictures = _pictures(t)
    truth = made(t, named(PUZZLES, select="SELECT id, fen, s2, s1 <> s2 AS other FROM puzzles"))
    pieces = F.map_filter(F.map_from_arrays(F.array("s2"), F.array(F.lit("Q"))), lambda s, q: F.col("other"))
    masks = layout.masks(pictures).withColumn("mask", F.transform_values("mask", lambda _, v: F.when(v == "uncertain", "empty").otherwise(v)))
    board = F.map_concat(F.map_filter(boards.to_map(F.col("fen")), lambda s, _: ~F.map_contains_key(pieces, s)), pieces)
    _, worst = layout.mask_quality(masks, truth.select("id", boards.from_map(board).alias("fen")))
    return worst.select("id", F.col("wrong").cast("long").alias("wrong"))


# Files with one to three pages each: a line of text, letters of a diagram font by their codes, a square by its lines and a box; streams stored or
# deflated by turns.
def _pdf_files(t) -> tuple:
    rows = dealt(t("supplier").select("s_suppkey")).selectExpr("s_suppkey AS p")

    def write(batches):
        for part in few(batches):
            paths, bodies = [], []
            for p in part["p"]:
                pages = int(p) % 3 + 1
                font = lambda name, width: f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /FirstChar 0 /Widths [{' '.join([str(width)] * 256)}] >>"
                objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {pages} /MediaBox [0 0 500 800] /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(pages))}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>", font("Roman", 600), font("ABCDEF+Chess#20Merida", 1000)]
                numbers = dict(enumerate(objects, 1))
                for k in range(pages):
                    body = f"q BT /F1 10 Tf 50 700 Td ({p} \\({k}\\)) Tj ET Q BT 1 0 0 rg /F2 12 Tf 1 0 0 1 60 {600 - 10 * k} Tm <C86B> Tj ET 100 100 m 120 100 l 120 120 l 100 120 l h S {30 + k} 40 50 60 re f".encode()
                    raw, kind = (zlib.compress(body), "/Filter /FlateDecode ") if (p + k) % 2 else (body, "")
                    numbers[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>"
                    numbers[11 + 2 * k] = f"<< {kind}/Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream"
                paths.append(f"{p}/book.pdf")
                bodies.append(b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + (x if isinstance(x, bytes) else x.encode()) + b"\nendobj\n" for n, x in numbers.items()) + b"trailer << /Root 1 0 R >>\n%%EOF")
            yield pd.DataFrame({"path": paths, "content": bodies})

    spark, root = rows.sparkSession, files.work_folder(rows.sparkSession, "pdf")
    files.write_each(rows.mapInPandas(write, "path string, content binary"), root)
    spark.dataSource.register(PdfPages)
    return spark, root


def _pdf(t, table: str):
    spark, root = _pdf_files(t)
    return spark.read.format("pdf_pages").option("table", table).load(root).withColumn("book", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).drop("file")


@query("""
WITH pages AS (SELECT s_suppkey AS p, k FROM supplier, range(0, 3) r(k) WHERE k <= s_suppkey % 3), lines AS (SELECT p, k, CAST(p AS STRING) || ' (' || CAST(k AS STRING) || ')' AS line FROM pages)
SELECT CAST(p AS STRING) AS book, CAST(k AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS seq, 50.0 + 6 * (i - 1) AS x0, CAST(90.0 AS DOUBLE) AS y0, 'Roman' AS font, 0 AS color, line[i] AS ch FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM lines)
UNION ALL SELECT CAST(p AS STRING), k, length(line), 60.0, 188.0 + 10 * k, 'Chess Merida', 16711680, 'È' FROM lines UNION ALL SELECT CAST(p AS STRING), k, length(line) + 1, 72.0, 188.0 + 10 * k, 'Chess Merida', 16711680, 'k' FROM lines""")
def pdf_glyphs(t):
    """Glyphs of the pages of all files of a folder."""
    return _pdf(t, "glyphs").select("book", "page", "seq", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"), "font", "color", "ch")


@query("""
SELECT CAST(s_suppkey AS STRING) AS book, CAST(k AS INTEGER) AS page, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(x + w AS DOUBLE) AS x1, CAST(y + h AS DOUBLE) AS y1, CAST(n AS INTEGER) AS items, n = 4 AS anchor
FROM supplier, range(0, 3) r(k), LATERAL (VALUES (100, 680, 20, 20, 4), (30 + k, 700, 50, 60, 1)) d(x, y, w, h, n) WHERE k <= s_suppkey % 3""")
def pdf_drawings(t):
    """Drawings of all pages, and which of them are anchors."""
    return _pdf(t, "drawings").select("book", "page", "x0", "y0", "x1", "y1", "items", layout.is_anchor(LAYOUT).alias("anchor"))

"""Queries of the readers and writers of books: each writes files into a new folder, in tasks, and reads them back.

A shelf has a book for every 50 customers: a file for each problem, pages of solutions, pictures and logs. Ids are those within a book,
so they repeat from book to book.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boardframe.functions import text
from boardframe.operators import export, overlay, state
from boardframe.plans import book
from boardframe.plans.catalogue import query
from boardframe.plans.generated import PUZZLES, made, named, oracle
from boardframe.sources import files, logs, readers
from boardframe.streaming.upsert import append_stream

BOARD = "6k1/5ppp/8/8/8/8/8/R5K1"

#: A problem for each customer: its book, its number i in it, name (as printed, with stars) and side; solutions are right but for every third.
SHELF = f"""
shelf AS (SELECT 'b' || CAST(CAST(floor(c_custkey / 50.0) AS BIGINT) AS STRING) AS book, CAST(floor(c_custkey / 50.0) AS BIGINT) AS place, c_custkey % 50 AS i, CAST(c_custkey % 50 AS STRING) AS id,
  CAST(c_custkey % 50 AS STRING) || repeat('*', CAST(c_custkey % 3 AS INT)) AS printed, '{BOARD} w' AS fen, CASE WHEN c_custkey % 4 = 0 THEN 'b' ELSE 'w' END AS side, c_mktsegment AS hint,
  'page_' || CAST(c_custkey % 5 AS STRING) AS page, CASE WHEN c_custkey % 3 > 0 THEN '1.Ra8#' ELSE '1.Rb8' END AS moves, c_custkey AS k FROM {{customer}})"""

#: Their files. Number 7 has another file of an earlier name, each book one that is no JSON, and every fifth solution is printed again on a later page.
FILES = f"""
solved AS (SELECT book, page, to_json(named_struct('solutions', array_sort(collect_list(named_struct('id', id || ' ' || hint || '-X', 'moves', moves))))) AS content FROM shelf GROUP BY book, page),
again AS (SELECT book, to_json(named_struct('solutions', collect_list(named_struct('id', id, 'moves', 'again')))) AS content FROM shelf WHERE i % 5 = 0 GROUP BY book),
all_files AS (
  SELECT book, 'problem_jsons/' || printed || '.json' AS path, to_json(named_struct('id', printed, 'fen', fen, 'to_move', side, 'hint', hint)) AS content FROM shelf
  UNION ALL SELECT book, 'problem_jsons/7!.json', '{{"id": "7**", "fen": "first", "to_move": "w"}}' FROM shelf WHERE i = 7
  UNION ALL SELECT DISTINCT book, 'problem_jsons/bad.json', '{{' FROM shelf
  UNION ALL SELECT book, 'solution_jsons/' || page || '.json', content FROM solved
  UNION ALL SELECT book, 'solution_jsons/page_x.json', content FROM again
  UNION ALL SELECT book, 'problem_images/' || printed || '.png', 'x' FROM shelf WHERE i % 2 = 1
  UNION ALL SELECT DISTINCT book, 'solution_images/' || page || '.png', 'x' FROM shelf WHERE i % 5 % 2 = 0
  UNION ALL SELECT book, 'fen_fixes.jsonl', array_join(array_sort(collect_list(to_json(named_struct('id', id, 'status', CASE WHEN i % 12 = 0 THEN 'UNRESOLVED' ELSE 'FIXED' END, 'fen', 'fixed/' || id, 'to_move', 'b')))), '\n') FROM shelf WHERE i % 6 = 0 GROUP BY book
  UNION ALL SELECT book, 'moves_fixes.jsonl', array_join(array_sort(collect_list(to_json(named_struct('id', id, 'moves', '1. Ra8# ' || id, 'status', 'REPAIRED')))), '\n') FROM shelf WHERE i % 9 = 0 GROUP BY book
  UNION ALL SELECT book, 'human_overrides.jsonl', array_join(array_sort(collect_list(to_json(named_struct('id', id, 'verdict', CASE WHEN i % 20 = 0 THEN 'exclude' ELSE 'fix' END, 'moves', '1. Ra1')))), '\n') FROM shelf WHERE i % 10 = 0 GROUP BY book)"""


def _shelf(t, more: str = "", where: str = "TRUE"):
    """A new shelf, written by tasks, and some more files (book, path, content)."""
    tables = SHELF + "," + FILES
    rows = made(t, named(tables, select=f"SELECT book || '/' || path AS path, content FROM (SELECT * FROM all_files {more}) WHERE {where}"))
    root = files.work_folder(rows.sparkSession, "shelf")
    files.write_each(rows, root)
    return rows.sparkSession, root


def shelf_sql(select: str) -> str:
    return named(oracle(SHELF), select=select)


@query(shelf_sql("SELECT book, printed AS id, fen, side AS to_move, hint FROM shelf"))
def problem_files(t):
    """Problems of all books; of two files for one id the later one by name counts."""
    spark, root = _shelf(t, where="path LIKE 'problem_jsons%'")
    return readers.problems(spark, f"{root}/*").select("book", "id", "fen", "to_move", "hint")


@query(shelf_sql("SELECT book, id, moves, hint || '-X' AS name FROM shelf"))
def solution_files(t):
    """Of a solution that is printed twice the first one counts."""
    spark, root = _shelf(t, where="path LIKE 'solution_jsons%'")
    rows = readers.solutions(spark, f"{root}/*").withColumns({"name": text.attribution(F.col("id")), "id": text.key(F.col("id"))})
    return state.first(rows, ["book", "id"]).select("book", "id", "moves", "name")


@query(shelf_sql("SELECT book, id, page || '.png' AS page FROM shelf WHERE i % 5 % 2 = 0"))
def page_index(t):
    spark, root = _shelf(t, where="path LIKE 'solution%'")
    return readers.page_index(spark, f"{root}/*").select("book", "id", F.regexp_extract("path", r"([^/]+)$", 1).alias("page"))


@query(shelf_sql("SELECT book, id, printed || '.png' AS image FROM shelf WHERE i % 2 = 1"))
def image_index(t):
    spark, root = _shelf(t, where="path LIKE 'problem_images%'")
    return readers.images(spark, f"{root}/*").select("book", "id", "image")


@query(shelf_sql(f"SELECT book, id, '{BOARD}' AS fen, side AS to_move, CASE WHEN k % 3 = 0 THEN '1.O-O ' || hint WHEN k % 3 = 1 THEN 'better' END AS moves FROM shelf"))
def native_maps(t):
    """Books that have maps by id, of boards, solutions and better solutions."""
    maps = f"""
    UNION ALL SELECT book, 'fens.json', to_json(map_from_entries(collect_list(struct(id, '{BOARD}' || CASE WHEN side = 'b' THEN ' b' ELSE '' END)))) FROM shelf GROUP BY book
    UNION ALL SELECT book, 'solutions.json', to_json(map_from_entries(collect_list(struct(id, named_struct('main', '1.0-0 ' || hint, 'text', 't'))))) FROM shelf WHERE k % 3 < 2 GROUP BY book
    UNION ALL SELECT book, 'overrides.json', to_json(map_from_entries(collect_list(struct(id, named_struct('main', 'better'))))) FROM shelf WHERE k % 3 = 1 GROUP BY book"""
    spark, root = _shelf(t, maps, "path IN ('fens.json', 'solutions.json', 'overrides.json')")
    own, moves = readers.native(spark, f"{root}/*")
    return own.join(moves, ["book", "id"], "left").select("book", "id", "fen", "to_move", "moves")


#: Every third book has a bundle, every fourth maps too.
KINDS = """
    UNION ALL SELECT DISTINCT book, 'fens.json', '{}' FROM shelf WHERE place % 4 = 0
    UNION ALL SELECT book, 'bundle/state/puzzles.jsonl', array_join(collect_list(to_json(named_struct('id', id, 'fen', 'bundled', 'to_move', 'w', 'moves', 'old')) || '\n' || to_json(named_struct('id', id, 'fen', 'bundled', 'to_move', side, 'moves', moves))), '\n')
      FROM shelf WHERE place % 3 = 0 GROUP BY book"""


@query(shelf_sql("SELECT DISTINCT book, TRUE AS problems, place % 4 = 0 AS maps, place % 3 = 0 AS bundle FROM shelf UNION ALL SELECT 'launched', FALSE, FALSE, FALSE"))
def discovered_books(t):
    """All books of a shelf by one scan of names, and the one launched from elsewhere; other folders do not count."""
    spark, root = _shelf(t, f"{KINDS} UNION ALL SELECT DISTINCT 'other' || book, 'notes/readme.txt', '' FROM shelf", "path NOT LIKE 'solution%' AND path NOT LIKE '%.png'")
    return readers.books(spark, root, f"{root}/elsewhere/launched").drop("path")


@query(shelf_sql("SELECT book, id, CASE WHEN place % 3 = 0 THEN 'bundled' ELSE fen END AS fen, side AS to_move, CASE WHEN place % 3 = 0 THEN moves END AS moves FROM shelf"))
def run_scan(t):
    """What was made of each book: its bundle's latest records or, where there is none, its problem files."""
    spark, root = _shelf(t, KINDS, "path LIKE 'problem_jsons%' OR path LIKE 'bundle%'")
    return readers.run(spark, f"{root}/*")


IMPORTED = """
SELECT book, id, CASE WHEN i % 2 = 1 THEN printed || '.png' END AS image, CASE WHEN i % 6 = 0 AND i % 12 > 0 THEN 'fixed/' || id ELSE '6k1/5ppp/8/8/8/8/8/R5K1' END AS fen,
  CASE WHEN i % 6 = 0 AND i % 12 > 0 THEN 'b' ELSE 'w' END AS to_move,
  CASE WHEN i % 10 = 0 AND i % 20 > 0 THEN '1. Ra1' WHEN i % 9 = 0 THEN '1. Ra8# ' || id ELSE moves END AS moves,
  CASE WHEN i % 20 = 0 THEN 'excluded' WHEN i % 10 = 0 THEN 'approved' ELSE 'recognized' END AS status, CAST(k % 3 AS INTEGER) AS difficulty, hint || '-X' AS game_name, hint FROM shelf"""


@query(shelf_sql(IMPORTED))
def shelf_import(t):
    """Problems, solutions, pictures, fixes of two kinds and overrides of all books, in one plan."""
    spark, root = _shelf(t)
    return book.imported(spark, f"{root}/*").select("book", "id", "image", "fen", "to_move", "moves", "status", "difficulty", "game_name", "hint")


@query("SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' || CAST(o_orderkey AS STRING) END AS name, 'Ra' || CAST(o_orderkey % 8 + 1 AS STRING) AS moves FROM orders")
def solution_lines(t):
    """Lines of one text; a line that names an id stands behind the solution that it names."""
    rows = t("orders").selectExpr("o_orderkey AS k", "CAST(o_orderkey AS STRING) || '.  Ra' || CAST(o_orderkey % 8 + 1 AS STRING) AS value", "CASE WHEN o_orderkey % 2 = 0 THEN 'Lichess x' || CAST(o_orderkey AS STRING) END AS named")
    spark, path = rows.sparkSession, files.work_folder(rows.sparkSession, "lines")
    body = rows.repartitionByRange("k").sortWithinPartitions("k").selectExpr("explode(filter(array(value, named, 'not a solution'), x -> x IS NOT NULL)) AS value")
    body.write.text(path)
    return readers.solution_lines(spark, path).select("id", "name", "moves")


APPENDED = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % {} DESC, event_id DESC) AS place FROM events) WHERE place = 1"


def _written(t):
    """Events as records of their users, those of a user in order within one task."""
    rows = t("events").selectExpr("CAST(user_id AS STRING) AS id", "event_type AS status", "event_id AS pos")
    return rows.repartition("id").sortWithinPartitions("pos")


@query(f"SELECT CAST(user_id AS STRING) AS id, event_type AS status, event_id AS pos FROM ({APPENDED.format(2)})")
def log_files(t):
    """Spoilt lines and two appends; the latest record of each id, compacted into another log."""
    rows = _written(t)
    spark, path = rows.sparkSession, files.work_folder(rows.sparkSession, "log")
    rows.where("pos % 100 = 0").selectExpr("explode(array('{spoilt', '', '{\"status\": \"no id\"}', to_json(struct(id, 'older' AS status)))) AS value").write.mode("append").text(f"{path}/log")
    state.append(rows.where("pos % 2 = 0"), f"{path}/log")
    state.append(rows.where("pos % 2 = 1"), f"{path}/log")
    logs.compact(spark, f"{path}/log", target=f"{path}/new")
    return readers.log(spark, f"{path}/new", "id string, status string, pos long").select("id", "status", "pos")


@query(f"""SELECT CAST(user_id AS STRING) AS id, event_type AS status, event_id AS pos, '{{"x' || CAST(event_id % 7 AS STRING) || '":{{"at":' || CAST(event_id AS STRING) || ',"by":["' || event_type || '"]}}}}' AS extra FROM ({APPENDED.format(3)})""")
def appended_log(t):
    """Three appends of the same ids, and a compaction in place before the last; each record has a field that no schema names. The latest records by
    the order of the appends, with all that was in them."""
    rows = _written(t).selectExpr("*", "map(concat('x', pos % 7), to_variant_object(named_struct('at', pos, 'by', array(status)))) AS _extra")
    spark, path = rows.sparkSession, files.work_folder(rows.sparkSession, "log")
    state.append(rows.where("pos % 3 = 0"), path)
    state.append(rows.where("pos % 3 = 1"), path)
    logs.compact(spark, path)
    state.append(rows.where("pos % 3 = 2"), path)
    found = state.latest(readers.log(spark, path, "id string, status string, pos long", extras=True))
    return found.select("id", "status", "pos", F.to_json("_extra").alias("extra"))


@query(f"SELECT CAST(user_id AS STRING) AS id, event_type AS status, event_id AS pos FROM ({APPENDED.format(3)})")
def streamed_log(t):
    """A stream of files into a log, stopped and gone on with twice, and compacted on the way; the latest record of each id."""
    rows = _written(t)
    spark, path = rows.sparkSession, files.work_folder(rows.sparkSession, "stream")
    for part in range(3):
        rows.where(f"pos % 3 = {part}").write.mode("append").json(f"{path}/in")
        source = spark.readStream.schema("id string, status string, pos long").json(f"{path}/in")
        append_stream(source, f"{path}/log", f"{path}/checkpoint", compact_every=2).awaitTermination()
    return state.latest(readers.log(spark, f"{path}/log", "id string, status string, pos long")).select("id", "status", "pos")


@query("""
SELECT CAST(doc_id AS STRING) AS id FROM documents d WHERE lang IN ('de', 'fr') AND EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def chosen_targets(t):
    """What is left to do: of some statuses, not finished (failures are tried again), and pictured."""
    report = t("documents").selectExpr("CAST(doc_id AS STRING) AS id", "lang AS status")
    done = t("labels").selectExpr("CAST(doc_id AS STRING) AS id", "quality")
    pictures = t("pages").selectExpr("CAST(page_id AS STRING) AS id")
    return state.targets(report, done, pictures, statuses=("de", "fr"), retry=F.col("quality") == 0).select("id")


@query(named(oracle(PUZZLES), select="""SELECT id AS lichess_id, '7k/' || """ + " || '/' || ".join(f"CASE WHEN r2 = {r} THEN (CASE WHEN f2 = 0 THEN '' ELSE CAST(f2 AS STRING) END) || 'R' || CAST(7 - f2 AS STRING) ELSE '8' END" for r in range(7, 1, -1)) + """ || '/7K b - - 1 1' AS fen, 'Kg8' AS moves, CASE WHEN d8 < 8 THEN 'Hide.' ELSE 'Find the best move.' END AS hint FROM puzzles WHERE go12 AND d7 > 1 AND d9 > 2"""))
def csv_puzzles(t):
    """Puzzles with ratings from 900 and a theme, of which all moves are legal, and their answers; the limit is above their number."""
    rows = made(t, named(PUZZLES, select="SELECT id AS PuzzleId, fen || ' w - - 0 1' AS FEN, s1 || s2 || ' h8g8' AS Moves, CASE WHEN d9 = 0 THEN 'bad' WHEN d9 < 3 THEN '800' ELSE '1000' END AS Rating, CASE WHEN d7 = 0 THEN 'long' WHEN d7 = 1 THEN 'mate' WHEN d8 < 8 THEN 'endgame short quiet' ELSE 'short' END AS Themes, 'u' AS GameUrl FROM puzzles"))
    spark, path = rows.sparkSession, files.work_folder(rows.sparkSession, "csv")
    rows.write.option("header", True).csv(path)
    found = readers.puzzle_csv(spark, path, want=1_000_000, seed=3, hints={"quiet": "Hide.", "mate": "Mate."})
    return readers.answer_key(found).join(found.select(F.col("id").alias("lichess_id"), "hint"), "lichess_id").select("lichess_id", "fen", "moves", "hint")


@query("SELECT CAST(c_custkey AS STRING) AS id, c_name AS hint FROM customer")
def gated_problems(t):
    """Written only because customers are numbered without a gap."""
    rows = t("customer").selectExpr("c_custkey AS number", "'8/8' AS fen", "'w' AS to_move", "c_name AS hint")
    spark, path = rows.sparkSession, files.work_folder(rows.sparkSession, "gated")
    low, high = rows.agg(F.min("number"), F.max("number")).first()
    export.write_problems(rows, path, low, high)
    return spark.read.schema(readers.PROBLEM).json(path).select("id", "hint")


VERDICTS = """
, puzzles AS (SELECT *, CASE WHEN i % 10 = 0 AND i % 20 > 0 THEN '1. Ra1' WHEN i % 9 = 0 THEN '1. Ra8# ' || id ELSE moves END AS line, i % 6 = 0 AND i % 12 > 0 AS fixed FROM shelf),
verdicts AS (SELECT *, CASE WHEN i % 20 = 0 THEN 'excluded' WHEN i % 10 = 0 THEN 'approved' WHEN fixed THEN 'needs_review' WHEN line = '1.Rb8' THEN 'needs_review' ELSE 'verified' END AS status FROM puzzles)"""


def verdict_sql(select: str) -> str:
    return named(oracle(SHELF) + VERDICTS, select=select)


@query(verdict_sql("""
SELECT CASE WHEN i % 20 = 0 THEN 'excluded' WHEN i % 10 = 0 THEN 'approved' ELSE 'recognized' END AS status, count(*) AS n, CAST(0 AS BIGINT) AS stage FROM verdicts GROUP BY 1
UNION ALL SELECT status, count(*), 1 FROM verdicts WHERE i % 10 > 0 GROUP BY 1
UNION ALL SELECT CASE WHEN status = 'verified' THEN 'readable' ELSE 'unreadable' END, count(*), 2 FROM verdicts WHERE status <> 'excluded' AND NOT fixed GROUP BY 1 UNION ALL SELECT 'skipped', count(*), 2 FROM verdicts WHERE status = 'excluded' OR fixed"""))
def bundle_commands(t):
    """Import of a shelf, status, verify and assemble; a compaction between them changes nothing."""
    spark, root = _shelf(t)
    bundle = f"{root}/all"
    book.load(spark, f"{root}/b*", bundle)
    saved = f"{root}/stages"
    # Each is written before the next command changes the log.
    book.status(spark, bundle).select("status", "n", F.lit(0).cast("long").alias("stage")).write.parquet(f"{saved}/0")
    book.verify(spark, bundle).select(F.col("verdict").alias("status"), "n", F.lit(1).cast("long").alias("stage")).write.parquet(f"{saved}/1")
    book.compact(spark, bundle)
    stats = book.assemble(spark, bundle, F.col("book"))
    sums = {"readable": F.col("full") + F.col("transformed") + F.col("mainline"), "unreadable": F.col("unparsed"), "skipped": F.col("skipped")}
    stats = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("status"), n.alias("n")) for c, n in sums.items()))).alias("x")).select("x.*", F.lit(2).cast("long").alias("stage"))
    return spark.read.parquet(f"{saved}/0", f"{saved}/1").unionByName(stats)


@query(verdict_sql("""
SELECT count(*) AS n, CAST(count(*) FILTER (line LIKE '%Ra8#%') AS BIGINT) AS moves_ok, CAST(count(*) FILTER (NOT fixed) AS BIGINT) AS fen_ok, CAST(0 AS BIGINT) AS missing,
  CAST(count(*) FILTER (status = 'verified') AS BIGINT) AS games FROM verdicts"""))
def book_rebuild(t):
    """A whole shelf, from its files to games, scored with a key, and the games of its files read again."""
    spark, root = _shelf(t)
    truth = readers.problems(spark, f"{root}/b*").select("book", text.bare_id(F.col("id")).alias("id"), F.lit(f"{BOARD} w - - 0 1").alias("fen"), F.lit("Ra8#").alias("moves"))
    score = book.rebuild(spark, f"{root}/b*", f"{root}/all", F.concat(F.lit("Book "), "book"), truth)["score"]
    games = spark.read.option("wholetext", True).text(f"{root}/all/exports/puzzles_verified").agg(F.sum(F.regexp_count("value", F.lit(r"\[FEN "))).cast("long").alias("games"))
    return score.crossJoin(games).select("n", "moves_ok", "fen_ok", "missing", "games")

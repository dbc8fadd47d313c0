"""Readers of a book's files as DataFrames with explicit schemas. Malformed records are skipped, missing paths give empty tables."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardframe.functions import boards, text
from boardframe.kernel import columns as kernel
from boardframe.sources import files, logs

PROBLEM = "id string, fen string, to_move string, hint string"
SOLUTION_PAGE = "solutions array<struct<id:string,moves:string>>, continuation string"
PUZZLE = "id string, image string, fen string, to_move string, moves string, status string, difficulty int, game_name string, hint string, sources struct<fen:string,moves:string>, ledger array<struct<stage:string,verdict:string,detail:string>>"
FEN_FIX = "id string, old_fen string, fen string, to_move string, caption string, status string, rounds double, variations_ok boolean, note string, confidence string, fen_fast string, fen_strong string, error string"
MOVE_FIX = "id string, fen string, to_move string, status string, note string, moves string, reocr_text string"
OVERRIDE = "id string, verdict string, fen string, to_move string, moves string"
EVENT = "ts string, stage string, summary string"
STATE = "bundle/state/puzzles.jsonl"
RECOGNITION = "cell string, number int, to_move string, hint string, fen string"


def book_of(path: Column, inside: str) -> Column:
    """The name of the folder of a book, from a path to ``inside`` of it."""
    return files.plain(F.regexp_extract(path, rf"([^/]+)/\Q{inside}\E(?:/|$)", 1))


def log(spark: SparkSession, path: str, schema: str, key: str = "id", *, extras: bool = False) -> DataFrame:
    """Records of an append-only log with their ``_pos``, which orders them as they were appended; see ``logs.records``."""
    return logs.records(spark, path, schema, key, extras=extras)


def book_log(spark: SparkSession, book: str, name: str, schema: str, key: str = "id", *, extras: bool = False) -> DataFrame:
    """Records of the log ``name`` of a book, or of each book that a pattern matches, with ``book``."""
    return logs.records(spark, f"{book}/{name}", schema, key, extras=extras, book=name)


def _documents(spark: SparkSession, book: str, folder: str, schema: str) -> DataFrame:
    """One JSON document for each file of a folder of one book, or of all that a pattern matches: its columns, book, page (the file's name without
    ending) and _pos (path). Files are found and read in tasks; how many books there are does not matter to the plan."""
    rows = files.below(spark, book, folder, ".json")
    try:
        rows = rows.select("value", F.col("file").alias("_pos")) if rows is not None else spark.read.option("wholetext", True).text(f"{book}/{folder}/*.json").select("value", F.col("_metadata.file_path").alias("_pos"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], "value string, _pos string")
    parsed = rows.select("_pos", F.from_json("value", schema).alias("r")).where("r IS NOT NULL")
    return parsed.select("_pos", book_of(F.col("_pos"), folder).alias("book"), F.regexp_extract("_pos", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("page"), "r.*")


def problems(spark: SparkSession, book: str) -> DataFrame:
    """Problems by book and bare id, the later file wins: book, id (as printed), fen, to_move, hint, _pos."""
    rows = _documents(spark, book, "problem_jsons", PROBLEM).drop("page").where("id IS NOT NULL")
    chosen = rows.groupBy("book", text.bare_id(F.col("id")).alias("_key")).agg(F.max_by(F.struct(*rows.columns), "_pos").alias("r"))
    return chosen.select("r.*")


def solution_pages(spark: SparkSession, book: str) -> DataFrame:
    return _documents(spark, book, "solution_jsons", SOLUTION_PAGE)


def solutions(spark: SparkSession, book: str) -> DataFrame:
    """All printed solutions: book, _pos (page and place), page, id (as printed), moves."""
    rows = solution_pages(spark, book).select("book", "_pos", "page", F.posexplode("solutions").alias("at", "s"))
    return rows.select("book", F.struct("_pos", "at").alias("_pos"), "page", "s.id", "s.moves").where("id IS NOT NULL")


def solution_lines(spark: SparkSession, path: str) -> DataFrame:
    """Solutions of a text: ``12. moves`` opens one, a line ``lichess X`` behind it names its id: id, name, moves, _pos. The parts of a file that
    tasks read are put in order one by one; only a part's first line is looked at from the part before."""
    rows = logs.lines(spark, path).withColumns({"file": F.col("_pos.file"), "block": F.col("_pos.block")})
    number = F.nullif(F.regexp_extract("value", r"^\s*(\d+)\.\s+\S", 1), F.lit(""))
    name = F.nullif(F.regexp_extract("value", r"(?i)^\s*lichess\s+(\S+)", 1), F.lit(""))
    marked = rows.select("_pos", "file", "block", "value", number.alias("number"), name.alias("name"))
    part = Window.partitionBy("file", "block").orderBy("_pos")
    marked = marked.withColumns({"_next": F.lead(F.struct("name")).over(part)})
    firsts = marked.groupBy("file", "block").agg(F.min_by("name", "_pos").alias("first"))
    firsts = firsts.select("file", "block", F.lead("first").over(Window.partitionBy("file").orderBy("block")).alias("behind"))
    found = marked.where("number IS NOT NULL").join(firsts, ["file", "block"])
    after = F.when(F.col("_next").isNull(), F.col("behind")).otherwise(F.col("_next.name"))
    return found.select(F.col("number").alias("id"), after.alias("name"), F.trim(F.regexp_replace("value", r"^\s*\d+\.\s+", "")).alias("moves"), "_pos")


def native(spark: SparkSession, book: str) -> tuple[DataFrame, DataFrame]:
    """Problems and solutions of books that have maps by id: fens.json, and maybe solutions.json and overrides.json, whose main line comes first.
    ``book`` may be a pattern; both have ``book``."""

    def entries(name: str, kind: str) -> DataFrame:
        own = files.below(spark, book, name)
        found = own is not None or files.glob(spark, f"{book}/{name}")
        whole = own.select("value", F.col("file").alias("p")) if own is not None else spark.read.option("wholetext", True).text(f"{book}/{name}").select("value", F.col("_metadata.file_path").alias("p")) if found else spark.createDataFrame([], "value string, p string")
        return whole.select(book_of(F.col("p"), name).alias("book"), F.explode(F.from_json("value", f"map<string,{kind}>")).alias("id", "v"))

    fens = entries("fens.json", "string")
    found = entries("solutions.json", "struct<main:string,text:string>").select("book", "id", F.col("v.main").alias("main"))
    better = entries("overrides.json", "struct<main:string>").select("book", "id", F.col("v.main").alias("better"))
    part = F.split(F.trim("v"), r"\s+")
    own = fens.select("book", "id", part[0].alias("fen"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("w")).alias("to_move"), F.lit(None).cast("string").alias("hint"))
    main = F.coalesce(F.nullif("better", F.lit("")), F.nullif("main", F.lit("")))
    moves = fens.select("book", "id").join(found, ["book", "id"], "left").join(better, ["book", "id"], "left").select("book", "id", text.fold_moves(main).alias("moves")).where("moves IS NOT NULL")
    return own, moves


def puzzle_csv(spark: SparkSession, path: str, *, want: int, seed: int = 0, low: int = 900, high: int = 1900, theme: str = "short", hints: dict[str, str] | None = None) -> DataFrame:
    """``want`` puzzles of a public CSV (PuzzleId, FEN, Moves, Rating, Themes, GameUrl): rated from low to high, of a theme, with two
    moves at least, all of them legal: number, id, fen (after the first move, where the puzzle starts), turn, sans, hint, rating, url.

    ``hints`` gives texts for themes, the first of a puzzle's themes that has one counts. The order is that of a hash of id and seed, so it does
    not depend on how rows lie."""
    rows = spark.read.schema("PuzzleId string, FEN string, Moves string, Rating string, Themes string, GameUrl string").csv(path, header=True, enforceSchema=False)
    rating, themes = F.col("Rating").try_cast("int"), F.split("Themes", " ")
    good = rating.between(low, high) & F.array_contains(themes, theme) & (F.size(F.split(F.trim("Moves"), r"\s+")) >= 2)
    played = rows.where(good).withColumn("p", kernel.play_coordinates("FEN", F.lit(None).cast("string"), "Moves")).where("p.fen IS NOT NULL")
    known = F.create_map(*(F.lit(x) for pair in (hints or {}).items() for x in pair)).cast("map<string,string>")
    hint = F.coalesce(F.try_element_at(F.filter(F.transform(themes, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()), F.lit(1)), F.lit("Find the best move."))
    turn = F.split("p.fen", " ")[1]
    first = played.orderBy(F.xxhash64("PuzzleId", F.lit(seed)), "PuzzleId").limit(want)
    chosen = first.select(F.xxhash64("PuzzleId", F.lit(seed)).alias("_order"), F.col("PuzzleId").alias("id"), F.col("p.fen").alias("fen"), turn.alias("turn"), F.col("p.sans").alias("sans"), hint.alias("hint"), rating.alias("rating"), F.coalesce("GameUrl", F.lit("")).alias("url"))
    # As many rows as were asked for.
    return chosen.withColumn("number", F.row_number().over(Window.orderBy("_order", "id")).cast("long")).drop("_order")


def answer_key(puzzles: DataFrame) -> DataFrame:
    """The truth of a book made of ``puzzle_csv``: id (the number), fen, moves, lichess_id."""
    return puzzles.select(F.col("number").cast("string").alias("id"), "fen", F.array_join("sans", " ").alias("moves"), F.col("id").alias("lichess_id"))


def images(spark: SparkSession, book: str, folder: str = "problem_images") -> DataFrame:
    """Pictures by book and exact bare id, never by pattern: book, id, image, path."""
    rows = files.below(spark, book, folder, ".png", content=False)
    try:
        rows = rows if rows is not None else spark.read.format("binaryFile").load(f"{book}/{folder}/*.png").select("path", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], "path string, file string")
    name = files.plain(F.regexp_extract("file", r"([^/]+)$", 1))
    found = rows.select(book_of(F.col("file"), folder).alias("book"), text.bare_id(F.regexp_replace(name, r"\.png$", "")).alias("id"), name.alias("image"), "path")
    return found.groupBy("book", "id").agg(F.max_by(F.struct("image", "path"), "image").alias("r")).select("book", "id", "r.image", "r.path")


def page_index(spark: SparkSession, book: str) -> DataFrame:
    """The page picture of each solution, where there is one: book, id, path."""
    pages = images(spark, book, "solution_images").select("book", F.col("id").alias("page"), "path")
    rows = solutions(spark, book).select("book", text.key(F.col("id")).alias("id"), "page", "_pos").join(pages, ["book", "page"])
    return rows.groupBy("book", "id").agg(F.max_by("path", "_pos").alias("path"))


#: What makes a folder a book: what lies in these.
MARKERS = ("problem_jsons", "fens.json", "bundle")


def books(spark: SparkSession, root: str, launched: str | None = None) -> DataFrame:
    """Folders below ``root`` that hold one of MARKERS, and always the one launched: book, path, problems, maps, bundle (what it holds).

    One scan of names, by tasks where these see the folder (``files.marked``); no file is opened. Empty folders and empty files are not seen."""
    base = files.qualified(spark, root)
    found = files.marked(spark, root, MARKERS)
    if found is None:
        wanted = [p for m in MARKERS if files.glob(spark, p := f"{root}/*/{m}")]
        found = spark.createDataFrame([], "path string, _kind string")
        if wanted:
            names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(wanted).select(files.plain(F.col("_metadata.file_path")).alias("p"))
            part = F.split(F.substring("p", len(base) + 2, 1 << 16), "/")
            found = names.select(F.concat(F.lit(f"{base}/"), part[0]).alias("path"), part[1].alias("_kind"))
    if launched:
        found = found.union(spark.range(1).select(F.lit(launched.rstrip("/")), F.lit(None).cast("string")))
    # A folder below ``root`` comes before the one launched, if they have one name.
    kinds = [F.coalesce(F.bool_or(F.col("_kind") == m), F.lit(False)).alias(name) for m, name in zip(MARKERS, ("problems", "maps", "bundle"), strict=True)]
    return found.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("book")).agg(F.max_by("path", F.col("_kind").isNotNull()).alias("path"), *kinds)


def run(spark: SparkSession, book: str, stage: str = "bundle") -> DataFrame:
    """What a pipeline made of books: book, id, fen, to_move, moves, from a book's bundle if it has one, else from its problem files."""
    from boardframe.operators.state import latest

    made = problems(spark, book).select("book", text.bare_id(F.col("id")).alias("id"), "fen", "to_move", F.lit(None).cast("string").alias("moves"))
    if stage != "bundle":
        return made
    bundled = latest(book_log(spark, book, STATE, PUZZLE), ["book", "id"]).select("book", "id", "fen", "to_move", "moves")
    return made.join(bundled.select("book").distinct(), "book", "left_anti").select(bundled.columns).union(bundled)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """An answer key (map from id to fen, moves, lichess_id) as rows."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,struct<fen:string,moves:string,lichess_id:string>>")).alias("id", "v"))
    return rows.select("id", "v.*")


def config(spark: SparkSession, *paths: str) -> dict[str, str]:
    """NAME=value lines of the first file that exists; comments and quotes go."""
    for path in paths:
        if files.exists(spark, path):
            pairs = [line.strip().partition("=") for line in files.read_text(spark, path).splitlines() if "=" in line and not line.startswith("#")]
            return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}
    return {}


def create_manifest(spark: SparkSession, root: str, title: str) -> dict:
    """The manifest of a book's folder, made if there is none."""
    path = f"{root}/manifest.json"
    if not files.exists(spark, path):
        files.write_text(spark, path, json.dumps({"title": title, "created": time.strftime("%F %T"), "profile": {}, "stages": {}}, ensure_ascii=False, indent=1))
    return json.loads(files.read_text(spark, path))


def raised(rows: DataFrame, bad: Column, what: str) -> DataFrame:
    """``rows``, failing as soon as one of them is bad."""
    return rows.where(F.when(bad, F.raise_error(F.lit(what)).cast("boolean")).otherwise(True))

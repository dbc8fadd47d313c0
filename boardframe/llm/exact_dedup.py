"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch, marked, without

#: Code points of white space that equality ignores.
SPACE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, *, prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (columns doc_id and text; others are not read, whatever their names).

    Texts are equal when identical without white space. Of equal texts the row with the most code points stays, then the
    smallest doc_id (null last), then any one of rows that repeat doc_id and text. Null texts count as empty, and empty
    texts are equal to each other. A first scan takes length and prefix hash; only texts that share both are read whole, by a second
    scan, which takes their full hash; elsewhere text_sha256 is null. No text moves. With ``digest_all`` the digest is a result for
    every row, so the one scan takes it for all, and the groups are refined on its rows.

    Returns doc_id, twin (xxhash64 of the text), keep_id, group_size, kept, text_sha256, refined (the level that settled the row: length,
    prefix, full).
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, SPACE, "")
    digest = F.sha2(bare, 256).alias("text_sha256")
    narrow = ["doc_id", F.xxhash64("text").alias("twin"), F.char_length(text).alias("n_chars"), F.octet_length(bare).alias("length"), F.xxhash64(F.substring(bare, 1, prefix_chars)).alias("prefix")]
    rows = scratch.save(docs.select(*narrow, *([digest] if digest_all else []), F.monotonically_increasing_id().alias("row")), "rows")

    # Texts are counted in every task before anything moves, so a hot length or group is a few rows here. Tables of their own let
    # adaptive execution split the joins on them.
    pairs = rows.groupBy("length", "prefix").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("length").agg(F.sum("n").alias("all")).where("all > 1").select("length", F.lit(True).alias("long"))
    prefixes = scratch.save(pairs.join(lengths, "length").select("length", "prefix", "long", (F.col("n") > 1).alias("shared")), "prefixes")
    rows = rows.join(prefixes, ["length", "prefix"], "left")
    alone = rows.where("shared IS NULL OR NOT shared")
    if digest_all:
        full = rows.where("shared")
    else:
        alone = alone.withColumn("text_sha256", F.lit(None).cast("string"))
        ids = scratch.save(rows.where("shared").select("doc_id").distinct(), "ids")
        shared = prefixes.where("shared").select("length", "prefix")
        full = marked(docs, ids).select(*narrow, digest).join(shared, ["length", "prefix"], "left_semi")
        full = scratch.save(full.withColumn("row", F.monotonically_increasing_id()), "full")
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("low"), F.bitwise_not("row").alias("row")))
    groups = scratch.save(full.groupBy("text_sha256").agg(F.count("*").alias("size"), best.alias("best")), "groups")
    found = full.join(groups, "text_sha256")
    out = ["doc_id", "twin", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256", "refined"]
    found = found.withColumns({"keep_id": F.bitwise_not("best.low"), "group_size": F.col("size"), "kept": F.bitwise_not("best.row") == F.col("row"), "refined": F.lit("full")})
    alone = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1), "kept": F.lit(True), "refined": F.when(F.col("long"), "prefix").otherwise("length")})
    return found.select(*out).union(alone.select(*out))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps. Of rows that repeat doc_id and text one stays."""
    scratch = Scratch(docs.sparkSession, "copies")
    found = exact_dedup(docs).where("refined = 'full'")
    texts = found.groupBy("doc_id", "twin").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every"))
    texts = scratch.save(texts.where("NOT every"), "texts")
    rest = without(docs, texts)
    # Repeated rows of which one stays.
    mixed = texts.where("some").select("doc_id", "twin")
    if not mixed.take(1):
        return rest
    some = marked(docs, mixed.select("doc_id"))
    same = some["doc_id"].eqNullSafe(mixed["doc_id"]) & (F.xxhash64(some["text"]) == mixed["twin"])
    return rest.unionByName(some.join(mixed, same, "left_semi").dropDuplicates(["doc_id", "text"]))

"""Near-duplicate lines by a join of deletion neighbourhoods, in DataFrame operations only.

Two lines within one edit share a variant: the line with one character deleted, or the line itself. A line of n characters
has n + 1 of them, so variants are narrowed before they are emitted: the edit lies in a block of the line, and outside it
both lines are equal. Blocks whose outside no other line shares are dropped and the others split, until a few
characters are left, and only those are deleted one by one. Nothing is lost, and a line costs its length times a logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch, marked

#: Lines of fewer characters are only compared exactly, unless asked for; and the fewest that have two halves. There are few different lines
#: that are shorter, so their variants are emitted at once.
MIN_CHARS, HALVED = 4, 4
#: Parts of a block, and characters of a block whose variants are emitted.
PARTS, FEW = 8, 8


def normalised(line: Column) -> Column:
    """Without white space at its ends, in lower case."""
    return F.lower(F.trim(line, F.lit(" \t\r\f\v")))


def place_of(doc_id: Column, line_no: Column) -> Column:
    """One number that orders lines by doc_id (null first) and number, so that minima need no sorting."""
    known = (doc_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)")
    return (F.coalesce(known, F.lit(-(1 << 31)).cast("decimal(31,0)")) + line_no).cast("decimal(38,0)")


def doc_of(place: Column) -> Column:
    return F.when(place >= 0, F.floor(place / F.lit(1 << 31)).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def line_of(place: Column) -> Column:
    return F.pmod(place, F.lit(1 << 31).cast("decimal(10,0)")).cast("long")


def halves(size: Column, line: Column) -> Column:
    """Hashes of a line's beginning and end, each of the power of two characters that is half of it at most. Lines that differ in one
    edit share one; where one character less makes the power smaller, both powers are taken."""
    power = [F.call_function("shiftleft", F.lit(1), F.floor(F.log2((n - 1) / 2)).cast("int")) for n in (size, size - 1)]
    first, last = ([F.xxhash64(F.lit(side), cut(line, n)) for n in power] for side, cut in ((0, F.left), (1, F.right)))
    return F.when(power[0] == power[1], F.array(first[0], last[0])).otherwise(F.array(*first, *last))


def outside(m: Column, u: Column, v: Column, line: Column) -> Column:
    """Hash of a line without the block [u, v) of its first m characters, or of as many if it has one more."""
    return F.xxhash64(m, u, v, F.left(line, u), F.right(line, m - v))


def _split(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (normalised) and its key, two hashes."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), normalised(F.col("raw")).alias("line"))
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(7), "line")})


def line_dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line of each row of ``docs`` (doc_id, text): doc_id, line_no, keep_doc_id, keep_line_no, kept, how.

    Lines are separated by line feeds and numbered from 1. Equal means equal after trimming and lower-casing; near means
    one edit apart (inserted, deleted or other character), for lines of ``min_chars`` characters at least.
    A line is kept if no equal or near line comes earlier, by doc_id (null first) and number; keep_* name the earliest of
    them. Blank lines are kept and equal nothing. Null texts have no lines, empty texts one blank line. Rows that repeat
    doc_id and text count as one document: their lines get the same verdicts. how: first, blank or later.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    size = F.char_length("line")
    rows = _split(docs).select("doc_id", "line_no", F.when(F.col("line") != "", F.col("k1")).alias("k1"), "k2", F.when(size >= max(min_chars, HALVED), halves(size, F.col("line"))).alias("halves"), ((size >= max(min_chars, 1)) & (size <= HALVED)).alias("short"))
    rows = scratch.save(rows, "rows")
    firsts = scratch.save(rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min(place_of(F.col("doc_id"), F.col("line_no"))).alias("first")), "firsts")

    # Lines that share a half with another line. A half that many lines share is counted where they lie.
    keyed = rows.where("halves IS NOT NULL").select("k1", "k2", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    shared = scratch.save(shared, "shared")  # a table of its own, so that the join may split a hot half
    able = keyed.join(shared, "half", "left_semi").select("k1", "k2").union(rows.where("short").select("k1", "k2")).distinct()
    able = scratch.save(able.join(firsts, ["k1", "k2"]).select("k1", "k2", "first", doc_of(F.col("first")).alias("w_doc"), line_of(F.col("first")).alias("w_line")), "able")

    # Their texts, from where each first stands.
    source = _split(marked(docs.select("doc_id", "text"), able.select(F.col("w_doc").alias("doc_id"))))
    same = (source["k1"] == able["k1"]) & (source["k2"] == able["k2"]) & source["doc_id"].eqNullSafe(able["w_doc"]) & (source["line_no"] == able["w_line"])
    text = source.join(able, same).select(able["k1"], able["k2"], "first", "line").dropDuplicates(["k1", "k2"])
    text = scratch.save(text, "texts")

    # Blocks: halves, with m the line's own length and one less, as the shorter line of a pair decides.
    # A short line, and one by which it is the longer of a pair, is one block.
    half = [(m, F.floor(m * i / 2).cast("int"), F.when(m < HALVED, m).otherwise(F.floor(m * (i + 1) / 2)).cast("int")) for m in (size, size - 1) for i in (0, 1)]
    state = text.select("k1", "k2", "first", "line", F.explode(F.array(*(F.struct(m.alias("m"), u.alias("u"), v.alias("v")) for m, u, v in half))).alias("b")).select("k1", "k2", "first", "line", "b.*")
    state, turn = scratch.save(_shared(state, scratch, "outside-0"), "blocks-0"), 0
    while (state.agg(F.max(F.col("v") - F.col("u"))).first()[0] or 0) > FEW:
        step = F.greatest(F.ceil((F.col("v") - F.col("u")) / PARTS), F.lit(1)).cast("int")
        parts = state.select("k1", "k2", "first", "line", "m", "v", F.explode(F.sequence("u", F.greatest(F.col("v") - 1, "u"), step)).alias("u"), step.alias("step")).withColumn("v", F.least(F.col("u") + F.col("step"), "v")).drop("step")
        turn += 1
        state = scratch.save(_shared(parts, scratch, f"outside-{turn}"), f"blocks-{turn}")
        scratch.drop(f"blocks-{turn - 1}")

    # Variants: a line of m characters without its character q, for its likes; with nothing deleted before q, for those that
    # have one more there; and a line of m + 1 characters without its character q.
    own, q = F.char_length("line") == F.col("m"), F.col("q")
    spots = state.select("k1", "k2", "first", "line", "m", F.explode(F.sequence("u", "v")).alias("q"), "v")
    less = spots.where(own & (q < F.col("v"))).select("k1", "k2", "first", F.xxhash64(F.lit(1), "m", "q", F.left("line", q), F.right("line", F.col("m") - q - 1)).alias("variant"))
    more = spots.select("k1", "k2", "first", F.xxhash64(F.lit(2), "m", "q", F.left("line", q), F.right("line", F.col("m") - q)).alias("variant"))
    variants = scratch.save(less.union(more).distinct(), "variants")
    # Lines with one variant are all within one edit of each other, so the earliest of them is all that each needs.
    least = variants.groupBy("variant").agg(F.min("first").alias("near"), F.count("*").alias("n")).where("n > 1").select("variant", "near")
    pairs = variants.join(least, "variant").where("near < first").select("k1", "k2", "first", "near").distinct()
    other = text.select(F.col("first").alias("near"), F.col("line").alias("other_line"))
    near = pairs.join(text.select("k1", "k2", "line"), ["k1", "k2"]).join(other, "near").where(F.levenshtein("line", "other_line", 1) == 1)
    near = scratch.save(near.groupBy("k1", "k2").agg(F.min("near").alias("near")), "near")

    best = firsts.join(near, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("near", "first").alias("best"))
    found = rows.drop("halves", "short").join(best, ["k1", "k2"], "left")
    own_place = place_of(F.col("doc_id"), F.col("line_no"))
    kept = F.coalesce(F.col("best") == own_place, F.lit(True))
    found = found.select("doc_id", "line_no", "k1", "best", kept.alias("kept"))
    how = F.when(F.col("k1").isNull(), "blank").when(F.col("kept"), "first").otherwise("later")
    return found.select("doc_id", "line_no", F.when(F.col("kept"), F.col("doc_id")).otherwise(doc_of(F.col("best"))).alias("keep_doc_id"), F.when(F.col("kept"), F.col("line_no")).otherwise(line_of(F.col("best"))).alias("keep_line_no"), "kept", how.alias("how"))


def _shared(blocks: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Blocks whose outside several lines share, counted where they lie before anything moves."""
    hashed = blocks.withColumn("h", outside(F.col("m"), F.col("u"), F.col("v"), F.col("line")))
    groups = scratch.save(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), tag)
    return hashed.join(groups, "h", "left_semi").drop("h")

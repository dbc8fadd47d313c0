"""Operators on ordered rows: gaps, runs, pairs, carried values and stitched texts.

Each takes ``by``, the columns within which order counts; rows of different groups never meet. Groups of more than SPAN rows are cut into
segments, each put in order by a task of its own; what has to cross from one to the next (a count, a carried value, an open run) is a
row for each segment. So no task sorts a large group, and small groups are scanned at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(ids: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Whole numbers from low to high that a column lacks."""
    return ids.sparkSession.range(low, high + 1).toDF(column).join(ids.select(F.col(column).cast("long").alias(column)).distinct(), column, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows share, and how many they are (n)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys other rows have too, with their number (n). However many rows share keys, each stays a row of its own."""
    return matched(rows, duplicates(rows, *keys), keys, ["n"])


def gate(rows: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """One row: missing, repeated and unnumbered ids, and whether there is none of them."""
    own = rows.agg(F.count_if(F.col(column).isNull()).alias("unnumbered"))
    twice = duplicates(rows.where(F.col(column).isNotNull()), column).agg(F.count("*").alias("repeated"))
    lost = missing(rows, column, low, high).agg(F.count("*").alias("missing"))
    return own.crossJoin(twice).crossJoin(lost).select("missing", "repeated", "unnumbered", (F.col("missing") + F.col("repeated") + F.col("unnumbered") == 0).alias("ok"))


#: Rows, or whole numbers, that one task puts in order.
SPAN = 1 << 16
#: Parts, by a power of two, that large groups are cut into at most, in two steps of PARTS each.
PARTS = 32


def matched(rows: DataFrame, other: DataFrame, keys: Sequence[str], take: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with some columns of ``other``, null keys being equal; without keys every row meets the one row of ``other``."""
    named = other.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *take)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, same, how).drop(*(f"_k_{k}" for k in keys))


def segments(rows: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``rows`` with ``_seg``: where a group has more than SPAN rows, the number of its segment, which ascends with the order; else 0.

    A first job counts groups and takes PARTS * PARTS - 1 places in the order from the large ones, those of least hash, as borders. These are
    part of the plan, so a row has one segment however often it is computed."""
    large = rows.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > SPAN)
    hot = matched(rows, large, by, [], "left_semi")
    places = hot.select(*order).orderBy(F.xxhash64(*order), *order).limit(PARTS * PARTS - 1).distinct().orderBy(*order).collect()
    if not places:
        return rows.withColumn("_seg", F.lit(0))
    types = {f.name: f.dataType for f in rows.select(*order).schema}
    place = lambda r: F.struct(*(F.lit(r[c]).cast(types[c]).alias(c) for c in order))
    fine = [places[i : i + PARTS] for i in range(0, len(places), PARTS)]
    here = F.struct(*order)
    # Borders up to a row: whole steps first, then those of the step that it falls into.
    step = F.size(F.filter(F.array(*(place(part[0]) for part in fine)), lambda b: b <= here))
    part = F.get(F.array(*(F.array(*map(place, part)) for part in fine)), step - 1)
    within = F.coalesce(F.size(F.filter(part, lambda b: b <= here)), F.lit(0))
    cut = (F.greatest(step - 1, F.lit(0)) * PARTS + within).cast("int")
    flagged = matched(rows, large.withColumn("_large", F.lit(True)), by, ["_large"], "left")
    return flagged.withColumn("_seg", F.when(F.col("_large"), cut).otherwise(0)).drop("_large")


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds a row's number within its group, from 0 on. The order has no ties."""
    cut = segments(rows, order, by)
    counts = cut.groupBy(*by, "_seg").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = cut.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_seg").orderBy(*order)) - 1)
    found = matched(own, counts.withColumn("_before", before), [*by, "_seg"], ["_before"])
    return found.withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_seg")


def carry(rows: DataFrame, value: Column, order: Sequence[str], by: Sequence[str], name: str, *, before: bool = False) -> DataFrame:
    """Adds the last ``value`` so far that is not null, with ``before`` only of earlier rows."""
    cut = segments(rows, order, by).withColumn("_value", value)
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    ends = cut.groupBy(*by, "_seg").agg(F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1))
    found = matched(cut.withColumn("_own", own), ends.withColumn("_in", earlier), [*by, "_seg"], ["_in"])
    return found.withColumn(name, F.coalesce("_own", "_in")).drop("_own", "_in", "_value", "_seg")


def islands(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive whole numbers: low, high, n. Spans of numbers are the unit of work; only runs that reach an edge of their span meet
    those of others."""
    span = F.floor(F.col(column) / SPAN)
    marked = rows.select(*by, column, span.alias("_span")).distinct().withColumn("_run", F.col(column) - F.row_number().over(Window.partitionBy(*by, "_span").orderBy(column)))
    local = marked.groupBy(*by, "_span", "_run").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n")).drop("_run", "_span")
    edge = (F.pmod("low", F.lit(SPAN)) == 0) | (F.pmod("high", F.lit(SPAN)) == SPAN - 1)
    order = Window.partitionBy(*by).orderBy("low")
    cut = local.where(edge).withColumn("_new", F.coalesce((F.col("low") > F.lag("high").over(order) + 1).cast("int"), F.lit(1)))
    whole = cut.withColumn("_run", F.sum("_new").over(order)).groupBy(*by, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).drop("_run")
    return local.where(~edge).unionByName(whole)


def places(rows: DataFrame, first: str, key: str) -> DataFrame:
    """Adds ``place``, a row's number from 1 among all by ``first``, then the whole number ``key``. Rows are counted by spans of keys, and
    numbered within these."""
    spanned = rows.withColumn("_span", F.floor(F.col(key) / SPAN))
    before = spanned.groupBy(first, "_span").agg(F.count("*").alias("_n"))
    # A row for each span.
    earlier = F.sum("_n").over(Window.orderBy(first, "_span").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select(first, "_span", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(first, "_span").orderBy(key))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (first, "_span")]
    found = spanned.withColumn("_own", own).alias("r").join(before.alias("b"), same)
    return found.select("r.*", (F.col("_own") + F.col("b._before")).cast("long").alias("place")).drop("_own", "_span")


def ranges(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Islands as texts like ``3-5`` or ``9``."""
    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    return islands(rows, column, by).select(*by, "low", F.when(F.col("low") == F.col("high"), low).otherwise(F.concat(low, F.lit("-"), high)).alias("pages"))


def runs(rows: DataFrame, column: str, by: Sequence[str], gap: int, *, mean: bool = False) -> DataFrame:
    """Runs whose neighbours are ``gap`` apart at most: low, high, n and the centre, rounded down; with ``mean`` that of all its values too, rounded
    down. Nulls are in none."""
    cut = segments(rows.where(F.col(column).isNotNull()).select(*by, column), [column], by)
    line = Window.partitionBy(*by, "_seg").orderBy(column)
    new = (F.col(column) - F.lag(column).over(line) > gap).cast("int")
    local = cut.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.groupBy(*by, "_seg", "_run").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"), F.sum(column).alias("_sum"))
    # Runs of neighbouring segments join if they are close: the first and the last of each segment.
    ends = local.groupBy(*by, "_seg").agg(F.max("_run").alias("_last"))
    local = matched(local, ends, [*by, "_seg"], ["_last"])
    edge = F.col("_run").isin(0) | (F.col("_run") == F.col("_last"))
    across = Window.partitionBy(*by).orderBy("low", "_seg")
    open_ = local.where(edge).withColumn("_new", F.coalesce((F.col("low") - F.lag("high").over(across) > gap).cast("int"), F.lit(1)))
    whole = open_.withColumn("_chain", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_chain").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("_sum").alias("_sum"))
    found = local.where(~edge).select(*by, "low", "high", "n", "_sum").unionByName(whole.drop("_chain"))
    found = found.withColumn("centre", F.floor((F.col("low") + F.col("high")) / 2))
    return (found.withColumn("mean", F.floor(F.col("_sum") / F.col("n"))) if mean else found).drop("_sum")


def longest_run(rows: DataFrame, flag: Column, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The most consecutive rows for which ``flag`` holds, 0 where it never does."""
    cut = segments(rows.select(*by, *order, F.coalesce(flag, F.lit(False)).alias("_flag")), order, by)
    line = Window.partitionBy(*by, "_seg").orderBy(*order)
    # A row's run is known by how many rows without the flag stand before it.
    marked = cut.withColumn("_run", F.count_if(~F.col("_flag")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    local = marked.groupBy(*by, "_seg", "_run").agg(F.count_if("_flag").alias("_n"), F.count("*").alias("_rows"))
    # Of each segment: its longest run, those at its ends, and whether it is all one run.
    ends = local.groupBy(*by, "_seg").agg(F.max("_n").alias("_best"), F.max_by("_n", -F.col("_run")).alias("_first"), F.min("_run").alias("_low"), F.max_by("_n", "_run").alias("_last"), F.sum("_rows").alias("_rows"), F.sum("_n").alias("_flags"))
    head = F.when(F.col("_low") == 0, F.col("_first")).otherwise(0)
    full = F.col("_flags") == F.col("_rows")
    past = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # What is open at a segment's begin: the end of the last one that is not all one run, and the whole ones since.
    upto = F.coalesce(F.sum("_rows").over(past), F.lit(0))
    across = ends.withColumns({"_head": head, "_full": full}).withColumn("_upto", upto)
    stop = F.when(~F.col("_full"), F.struct(F.col("_last").alias("n"), (F.col("_upto") + F.col("_rows")).alias("at")))
    across = across.withColumn("_stop", F.last(stop, ignorenulls=True).over(past))
    open_ = F.coalesce(F.col("_stop.n"), F.lit(0)) + F.col("_upto") - F.coalesce(F.col("_stop.at"), F.lit(0))
    return across.groupBy(*by).agg(F.max(F.greatest("_best", F.col("_head") + open_)).alias("longest"))


def pairs(rows: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), *, even: bool = False) -> DataFrame:
    """Neighbours two by two: first and second. A last odd one has no second or, with ``even``, fails the job."""
    marked = numbered(rows, order, by, "_n")
    found = marked.groupBy(*by, F.floor(F.col("_n") / 2).alias("pair")).agg(F.max(F.when(F.col("_n") % 2 == 0, F.col(value))).alias("first"), F.max(F.when(F.col("_n") % 2 == 1, F.col(value))).alias("second"), F.count("*").alias("_size"))
    if even:
        found = found.where(F.when(F.col("_size") == 2, True).otherwise(F.raise_error(F.lit("an odd number of rows cannot be paired")).cast("boolean")))
    return found.drop("_size")


def widest_gap(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The widest step between neighbours in order, the lowest of several: low, high, gap. Nulls do not count; a group of one value has none."""
    known = segments(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), ["_v"], by)
    inner = known.select(*by, F.col("_v").alias("low"), F.lead("_v").over(Window.partitionBy(*by, "_seg").orderBy("_v")).alias("high"))
    edges = known.groupBy(*by, "_seg").agg(F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    outer = edges.select(*by, F.col("_last").alias("low"), F.lead("_first").over(Window.partitionBy(*by).orderBy("_seg")).alias("high"))
    steps = inner.unionByName(outer).where("high IS NOT NULL").withColumn("gap", F.col("high") - F.col("low"))
    return steps.groupBy(*by).agg(F.max_by(F.struct("low", "high", "gap"), F.struct("gap", -F.col("low"))).alias("_best")).where("_best IS NOT NULL").select(*by, "_best.*")


def stitched(rows: DataFrame, text: str, order: Sequence[str], by: Sequence[str], separator: str = " ") -> DataFrame:
    """A group's texts in order, as one."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, text))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias(text))


def majority(rows: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The most frequent value of a group; of several the one seen first, then the smallest. Nulls do not vote; a group of nulls has none."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order[0] if len(order) == 1 else F.struct(*order)).alias("seen"))
    line = Window.partitionBy(*by).orderBy(F.desc("n"), "seen", value)
    return votes.withColumn("_k", F.row_number().over(line)).where("_k = 1").select(*by, value, F.col("n").alias("votes"))


def stitch_pages(pages: DataFrame, order: str = "page", by: Sequence[str] = (), *, expected: tuple[int, int] | None = None) -> DataFrame:
    """Solutions (id, moves) of OCR pages (page, solutions array of (id, moves), continuation), within ``by`` if given.

    ``Position`` before an id goes; a page's continuation is added to the last solution of the nearest page before that has
    one; a continuation with none before it is left out. The order over pages is one of their heads alone. With
    ``expected`` (first and last page) nothing is stitched if a page between is missing.
    """
    if expected and (lost := missing(pages, order, *expected).orderBy(order).limit(1).collect()):
        raise ValueError(f"page {lost[0][0]} is missing")
    slim = pages.select(*by, order, (F.size("solutions") > 0).alias("_some"), F.nullif(F.trim("continuation"), F.lit("")).alias("more"))
    heads = carry(slim, F.when(F.col("_some"), F.col(order)), [order], by, "owner", before=True)
    more = stitched(heads.where("owner IS NOT NULL AND more IS NOT NULL"), "more", [order], [*by, "owner"]).withColumnRenamed("owner", order)
    items = pages.select(*by, order, F.size("solutions").alias("_n"), F.posexplode("solutions").alias("at", "s")).join(more, [*by, order], "left")
    moves = F.when((F.col("at") == F.col("_n") - 1) & F.col("more").isNotNull(), F.trim(F.concat_ws(" ", F.rtrim("s.moves"), "more"))).otherwise(F.col("s.moves"))
    return items.select(*by, order, F.col("at").alias("place"), F.trim(F.regexp_replace("s.id", r"(?i)^\s*Position\s*", "")).alias("id"), moves.alias("moves"))

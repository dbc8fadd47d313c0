"""Keyed append-only logs: the latest or first record of a key, counts, compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardframe.sources import logs

STATUSES = ("detected", "recognized", "verified", "needs_review", "no_solution", "approved", "excluded")
ACCEPTED_FENS = ("FIXED", "SHIFT_FIXED", "MOVES_SUSPECT")
ACCEPTED_MOVES = ("REPAIRED", "REOCRED")


def _pick(rows: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """One whole record for each key. Every task keeps its first row of a key before anything moves, so a hot key moves as a few rows, and
    columns that nobody reads are not read."""
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return known.withColumn("_place", place).where("_place = 1").drop("_place")


def latest(rows: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str] = ("_pos",)) -> DataFrame:
    """Last write wins; rows without a key are dropped. ``order`` must have no ties within a key."""
    return _pick(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def first(rows: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str] = ("_pos",)) -> DataFrame:
    """First write wins."""
    return _pick(rows, keys, [F.col(c).asc_nulls_last() for c in order])


def latest_accepted(log: DataFrame, accepted: Sequence[str], *, buried: bool = False, keys: Sequence[str] = ("id",), order: Sequence[str] = ("_pos",), status: str = "status") -> DataFrame:
    """The latest accepted record of each key. With ``buried`` a later record that was not accepted hides it."""
    good = F.col(status).isin(*accepted)
    return latest(log, keys, order).where(good) if buried else latest(log.where(good), keys, order)


def counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """Rows by value, null as ``?``."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("?")).alias(column)).agg(F.count("*").alias("n"))


def with_entry(ledger: Column, stage: str, verdict: Column, detail: Column) -> Column:
    """A ledger with one entry more, its detail cut to 300 characters."""
    entry = F.struct(F.lit(stage).alias("stage"), verdict.alias("verdict"), F.left(F.coalesce(detail, F.lit("")), F.lit(300)).alias("detail"))
    return F.array_append(F.coalesce(ledger, F.array().cast("array<struct<stage:string,verdict:string,detail:string>>")), entry)


def without_done(targets: DataFrame, done: DataFrame, key: str = "id", *, retry: Column | None = None) -> DataFrame:
    """Targets that a log has not finished; records that ``retry`` holds for do not count as finished."""
    ended = done if retry is None else done.where(~F.coalesce(retry, F.lit(False)))
    return targets.join(ended.select(key).distinct(), key, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """One JSON line for each row, behind all that was appended before; see ``logs``."""
    logs.append(rows, path)


def append_event(spark, path: str, stage: str, summary: str, **extras: str) -> None:
    row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit(stage).alias("stage"), F.lit(summary).alias("summary"), *(F.lit(v).alias(k) for k, v in extras.items()))
    append(row, path)


def targets(report: DataFrame, done: DataFrame, images: DataFrame, *, statuses: Sequence[str] = ("ILLEGAL", "STRUCT"), ids: Sequence[str] | None = None, limit: int | None = None, retry: Column | None = None, key: str = "id", order: Sequence[str] = ("id",)) -> DataFrame:
    """What of a ``report`` (key, status) is to be worked on: the named ids, done or not, or else those of some statuses that ``done`` has not
    finished (see ``without_done``); of these the ones with a picture in ``images``, the first ``limit`` by ``order`` if there is one."""
    chosen = report.where(F.col(key).isin(*ids)) if ids is not None else without_done(report.where(F.col("status").isin(*statuses)), done, key, retry=retry)
    pictured = chosen.join(images.select(key).distinct(), key, "left_semi")
    return pictured.orderBy(*order).limit(limit) if limit else pictured

"""A training corpus in five stages over the table documents.

Each stage takes what its predecessor kept, decides over all of it, and returns its rows with the columns of documents; the last
one returns packed pieces. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardframe.llm import queries
from boardframe.llm.decontaminate import decontaminate
from boardframe.llm.exact_dedup import drop_copies
from boardframe.llm.jaccard_join import similar
from boardframe.llm.language import keep_identified, train
from boardframe.llm.packing import pack_documents
from boardframe.llm.store import Scratch, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents outside the held-out third; undetermined and unsure documents go."""
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("text", "lang"))
    return keep_identified(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component over five-word shingles and a similarity of 0.8 the smallest doc_id stays."""
    found = similar(docs, words=5, percent=80, count=False).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(docs, Scratch(spark, "near").save(found.select("doc_id", "twin"), "found"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate(docs, queries.read(spark, sf_dir, "benchmark"), short=True).where("contaminated")
    return without(docs, Scratch(spark, "clean").save(found.select("doc_id", "twin"), "found"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, queries._vocabulary(), end_id=queries.END_ID)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No SQL expresses mixtures, token ids or packing; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return scratch.save(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])

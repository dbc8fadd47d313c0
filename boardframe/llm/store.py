"""Intermediate tables in the folder that the driver and all executors share.

A table written there cuts the lineage and survives the loss of executors. The folder is the one in
``spark.checkpoint.dir``; only where that is unset (local tests) a temporary folder is used instead.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch at most, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: Bits for each marked document, and the most and fewest bits, as powers of two, of the table that ``marked`` looks them up in.
BITS_EACH, DOC_BITS = 8, (16, 23)


def shared_dir(spark: SparkSession) -> str:
    """The folder; on a cluster it must be set, as a local one would be another on every machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="boardframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Scratch:
    """A new folder below the shared one. ``save`` writes a table and returns it as read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/boardframe-{name}-{uuid.uuid4().hex}"
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{tag}")

    def drop(self, tag: str) -> None:
        """Deletes a table that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tag}")
        path.getFileSystem(conf).delete(path, True)


def _is_marked(ids: DataFrame) -> Column | None:
    """Whether the column doc_id may be one of ``ids`` (doc_id), by a table of bits that grows with their number; None if they are too many
    for the largest table to leave out most others."""
    count = ids.count()
    bits = max((BITS_EACH * count - 1).bit_length(), DOC_BITS[0]) if count else DOC_BITS[0]
    if bits > DOC_BITS[1]:
        return None
    bit = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = ids.select(F.shiftrightunsigned(bit, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), "<i8")
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    byte = F.conv(F.hex(F.substring(F.lit(table.tobytes()), (F.shiftrightunsigned(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with one of these doc_ids, and some others, so that few texts move to the join that follows. Where the ids are too many for a
    table of bits (DOC_BITS, BITS_EACH), that join alone decides, and all texts move to it."""
    test = _is_marked(ids)
    return docs if test is None else docs.where(test)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, twin: xxhash64 of the text). Only texts that may be among them move, unless there are
    too many ids (see ``marked``)."""
    gone = gone.select("doc_id", "twin").distinct()
    test = _is_marked(gone.select("doc_id"))
    some = docs if test is None else docs.where(test)
    same = some["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(some["text"]) == gone["twin"])
    left = some.join(gone, same, "left_anti")
    return left if test is None else docs.where(~test).unionByName(left)

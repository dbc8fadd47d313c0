"""An append-only log kept by a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from boardframe.sources import logs


def append_stream(changes: DataFrame, log: str, checkpoint: str, *, compact_every: int = 0, keys: tuple[str, ...] = ("id",)) -> StreamingQuery:
    """Every batch of ``changes`` is one append to ``log``. A batch that is run again after a failure is not appended twice, as its segment is named
    by the stream and the batch. With ``compact_every`` the log is compacted after every so many batches; its readers never wait.

    The latest records are ``state.latest(readers.log(...))``, at any time and from any job."""

    def add(batch: DataFrame, number: int) -> None:
        token = hashlib.md5(f"{checkpoint} {number}".encode(), usedforsecurity=False).hexdigest()
        logs.append(batch, log, token=token)
        if compact_every and (number + 1) % compact_every == 0:
            logs.compact(batch.sparkSession, log, keys)

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

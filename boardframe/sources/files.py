"""Folders and small files wherever Spark can read them: local, HDFS, object stores."""

from __future__ import annotations

import fnmatch
import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    store, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _at(spark, path)
    source = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file as one write, replacing one there is."""
    store, where = _at(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def matches(pattern: str, name: str) -> bool:
    return re.fullmatch(pattern, name) is not None


def glob(spark: SparkSession, pattern: str) -> bool:
    """Whether there is anything that a pattern of Hadoop's matches."""
    store, where = _at(spark, pattern)
    return bool(store.globStatus(where) or [])


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as paths of files are given."""
    store, where = _at(spark, path)
    return store.makeQualified(where).toString()


def plain(path: Column) -> Column:
    """A file's path (``_metadata.file_path``) as it is written, without encoded signs."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def rename(spark: SparkSession, source: str, target: str) -> str:
    """Moves a file or folder in one step; the new name's last part. Fails if there is one of that name."""
    store, there = _at(spark, target)
    store.mkdirs(there.getParent())
    if store.exists(there) or not store.rename(_at(spark, source)[1], there):
        raise FileExistsError(target)
    return there.getName()


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def write_each(rows: DataFrame, root: str) -> int:
    """Writes a file for each row of ``rows`` (path below ``root``, content: text or bytes), in the tasks; how many. ``root`` is a local folder that all share, or
    a place that pyarrow reaches. Files are renamed into place, so a task that runs twice leaves each whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder, name = os.path.split(f"{base}/{path}")
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(hidden := f"{folder}/._{uuid.uuid4().hex}") as out:
                    body = content.as_py() or ""
                    out.write(body if isinstance(body, bytes) else body.encode())
                store.move(hidden, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _encoded(path: str) -> str:
    """A path as ``_metadata.file_path`` gives it."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*/;:@&=+$,\x80-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def _local(spark: SparkSession, path: str) -> str | None:
    """A folder's path for tasks, if they see it as the driver does (``file:``) and it is no pattern."""
    base = qualified(spark, path) if path else ""
    return None if not base.startswith("file:/") or re.search(r"[*?\[\]{}\\]", path) else "/" + base[5:].strip("/")


def _names(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Names in a folder that a pattern matches, or the one that it is; one task lists them, all get some."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = not re.search(r"[*?]", pattern)
            names = [] if not batch.num_rows else [pattern] if one else [n for n in os.listdir(root) if fnmatch.fnmatchcase(n, pattern)] if os.path.isdir(root) else []
            yield pa.RecordBatch.from_pydict({"name": names}, schema=pa.schema([("name", pa.string())]))

    return spark.range(1, numPartitions=1).mapInArrow(named, "name string").repartition(4 * spark.sparkContext.defaultParallelism)


def _hidden(name: str) -> bool:
    """Names that Spark does not list."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _filled(at: str) -> bool:
    """Whether there is a file that is not empty, at a path or at any depth below."""
    if os.path.isfile(at):
        return os.path.getsize(at) > 0
    if not os.path.isdir(at):
        return False
    with os.scandir(at) as entries:
        held = [e for e in entries if not _hidden(e.name)]
    return any(e.is_file() and e.stat().st_size > 0 for e in held) or any(e.is_dir() and _filled(e.path) for e in held)


def marked(spark: SparkSession, root: str, markers: Sequence[str]) -> DataFrame | None:
    """path, _kind: the folders in ``root`` and which of ``markers`` each holds, as a file that is not empty or a folder with one. Tasks look into
    folders and stop at the first such file, so nothing of files comes to the driver; None where they cannot, as in ``below``."""
    at = _local(spark, root)
    if at is None:
        return None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(f"file:{at}/{name}", m) for name in batch.column(0).to_pylist() for m in markers if _filled(f"{at}/{name}/{m}")]
            yield pa.RecordBatch.from_pydict({"path": [x for x, _ in held], "_kind": [x for _, x in held]}, schema=pa.schema([("path", pa.string()), ("_kind", pa.string())]))

    return _names(spark, at, "*").mapInArrow(look, "path string, _kind string")


def below(spark: SparkSession, book: str, inside: str, ending: str = "", *, content: bool = True) -> DataFrame | None:
    """The files of a folder ``inside`` of a book, or of each book that a pattern matches, whose names end with ``ending``, or the file ``inside``:
    file (its path, encoded), path (as it is written) and, with ``content``, value (its text).

    Tasks list folders and read files, so the driver knows of none, however many there are; one task names the books. For folders that all tasks
    see as the driver does (``file:``), and patterns of a book's name alone; else None, as Spark's own reader has to list them."""
    parent, _, pattern = book.rstrip("/").rpartition("/")
    root = _local(spark, parent)
    if root is None or re.search(r"[\[\]{}\\]", pattern):
        return None

    def found(name: str) -> Iterator[str]:
        at = f"{root}/{name}/{inside}"
        if os.path.isfile(at):
            yield at
        elif os.path.isdir(at):
            with os.scandir(at) as entries:
                yield from (e.path for e in entries if e.name.endswith(ending) and not e.name.startswith((".", "_")) and e.is_file())

    kinds = pa.schema([("file", pa.string()), ("path", pa.string())] + [("value", pa.string())] * content)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path in (p for name in batch.column(0).to_pylist() for p in found(name)):
                row = (_encoded(f"file:{path}"), f"file:{path}")
                if content:
                    with open(path, "rb") as source:
                        row += (source.read().decode("utf-8", "replace"),)
                rows.append(row)
                size += len(row[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=kinds)

    return _names(spark, root, pattern).mapInArrow(read, "file string, path string" + ", value string" * content)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: below ``spark.checkpoint.dir`` or, on one machine without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="boardframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

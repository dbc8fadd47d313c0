"""Solutions set as running text: headers that count only in sequence, bodies from the lines between them.

``spans`` (doc, page, line, seq, font, size, text) are a document's text in reading order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardframe.functions import text
from boardframe.operators.sequences import carry

# Fixed value: what names are made of, in a line of names alone as under a quotation or where a chapter divides entries.
NAMES = r"[A-Z][a-zA-Z.'\- ]+"
# Fixed value: two names or more at the end of a main line, which belong to the next chapter.
LAST_NAMES = r"\s*[A-Z][a-zA-Z.'\-]+(?:\s+[A-Z][a-zA-Z.'\-]+)+\s*"


def lines(spans: DataFrame, *, exclude_fonts: Sequence[str] = (), furniture: Sequence[str] = (), max_size: float = 1e9) -> DataFrame:
    """One row for each line that is body text: its text, bold text, and whether its first and all of its spans are bold or italic.

    Spans in excluded fonts, lines that begin like page furniture, and large titles are left out."""
    has = lambda word: F.col("font").contains(word)
    odd = F.exists(F.array(*map(F.lit, exclude_fonts)), lambda f: F.contains(F.col("font"), f)) if exclude_fonts else F.lit(False)
    kept = spans.where(~odd)
    parts = F.array_sort(F.collect_list(F.struct("seq", "text", has("Bold").alias("bold"), has("Italic").alias("italic"), "size")))
    rows = kept.groupBy("doc", "page", "line").agg(parts.alias("s"))
    join = lambda p: F.array_join(F.transform(p, lambda x: x["text"]), "")
    rows = rows.select("doc", "page", "line", F.trim(join(F.col("s"))).alias("plain"), join(F.filter("s", lambda x: x["bold"])).alias("bold"), F.col("s")[0]["bold"].alias("first_bold"), F.forall("s", lambda x: x["bold"]).alias("all_bold"), F.forall("s", lambda x: x["italic"]).alias("all_italic"), F.col("s")[0]["size"].alias("size"))
    rows = rows.where((F.col("plain") != "") & (F.col("size") <= max_size))
    return rows.where(~F.col("plain").rlike("^(?:" + "|".join(furniture) + ")")) if furniture else rows


def headers(body: DataFrame, first: int = 1) -> DataFrame:
    """Lines that open an entry: bold ones with a number, if it is the next one. One pass over the candidates of a document, in order."""
    number = F.regexp_extract("plain", r"^(\d+)\.\s+.+", 1).try_cast("long")
    able = body.where(F.col("first_bold")).select("doc", "page", "line", number.alias("number")).where("number IS NOT NULL")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, want = [], first
        for batch in batches:
            keep = []
            for doc, n in zip(batch.column("doc").to_pylist(), batch.column("number").to_pylist(), strict=True):
                if [doc] != own:
                    own, want = [doc], first
                keep.append(n == want)
                want += n == want
            yield batch.filter(pa.array(keep, pa.bool_()))

    # A task reads its documents one behind the other, so their number costs nothing and none is held.
    return able.repartition("doc").sortWithinPartitions("doc", "page", "line").mapInArrow(accept, able.schema)


def entries(spans: DataFrame, *, first: int = 1, **options) -> DataFrame:
    """doc, number, white, black, event, main, text of each entry; lines before the first entry, quotations in italics and lines of names alone do not count."""
    body = lines(spans, **options)
    rows = body.join(headers(body, first), ["doc", "page", "line"], "left")
    rows = carry(rows, F.col("number"), ["page", "line"], ["doc"], "entry")
    head = F.regexp_extract("plain", r"^\d+\.\s+(.+)", 1)
    opened = rows.where("number IS NOT NULL").select("doc", "number", *_players(head))
    names = F.col("all_bold") & ~F.col("plain").rlike(r"\d") & F.col("plain").rlike(f"^{NAMES}$")
    prose = rows.where(F.col("number").isNull() & F.col("entry").isNotNull() & ~F.col("all_italic") & ~names)
    parts = F.array_sort(F.collect_list(F.struct("page", "line", "bold", "plain")))
    joined = prose.groupBy("doc", F.col("entry").alias("number")).agg(parts.alias("s"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    main = tidy(text.figurines(F.array_join(F.transform("s", lambda x: x["bold"]), "")))
    whole = tidy(text.figurines(F.array_join(F.transform("s", lambda x: x["plain"]), " ")))
    joined = joined.select("doc", "number", F.regexp_replace(main, f"{LAST_NAMES}$", "").alias("main"), whole.alias("text"))
    return opened.join(joined, ["doc", "number"], "left").na.fill("", ["main", "text"])


def _players(head: Column) -> list[Column]:
    """White and black around a dash, the event behind the first comma."""
    parts = [F.trim(F.regexp_extract(head, r"^([^,–]*)(?:–([^,]*))?(?:,(.*))?$", i)) for i in (1, 2, 3)]
    return [c.alias(n) for c, n in zip(parts, ("white", "black", "event"), strict=True)]


def sample_places(puzzles: DataFrame, *, columns: int = 2, rows: int = 3, solutions: int = 34) -> DataFrame:
    """Where numbered puzzles (number from 1) stand in a generated book: page, column and row of the diagram, and page of the solution."""
    at, cell = F.col("number") - 1, columns * rows
    place = {"page": F.floor(at / cell) + 1, "column": at % columns, "row": F.floor(at % cell / columns), "solution_page": F.floor(at / solutions) + 1}
    return puzzles.withColumns({k: v.cast("int") for k, v in place.items()})


def crops(cells: DataFrame, zoom: float) -> DataFrame:
    """Cells in pixels of a page drawn at ``zoom``, cut down to whole ones: num, side, left, top, right, bottom."""
    names = dict(zip(("left", "top", "right", "bottom"), ("x0", "y0", "x1", "y1"), strict=True))
    return cells.select("page", "num", "side", *((F.col(c) * zoom).cast("int").alias(n) for n, c in names.items()))


def merged_sides(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Sides by number, of cells (num, side) over those ``known`` from earlier runs (num, side): a cell that was read again counts, with or without
    a side; of a number that several cells have, the one that comes last by page and place, if they have these."""
    order = [c for c in ("page", "place") if c in cells.columns]
    numbered = cells.where("num IS NOT NULL")
    new = numbered.groupBy("num").agg((F.max_by(F.struct("side"), F.struct(*order)) if order else F.max(F.struct("side"))).alias("s")).select("num", "s.side")
    return known.select("num", "side").join(new, "num", "left_anti").unionByName(new)

"""How the words of each source differ from its language, and sources of a language from each other.

Counts of (language, source, term) are sparse. A term's share has a floor for terms that do not occur, so a sum over all terms is
that of the floors, for which their number suffices, plus corrections for terms that do occur. The largest differences of each
group are found by radix selection: histograms of ever lower bits of the value narrow down the k-th largest, histograms of
UTF-8 bytes the last of those equal to it. Every histogram is pre-aggregated in the tasks; no group is sorted or gathered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch
from boardframe.llm.tokens import forget

#: Letters of ASCII in lower case and all other characters as they are; what parts terms becomes a space.
LETTERS = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))
#: Terms that a task holds before it hands their counts on, and bytes of a text that are split at once.
HELD, PIECE = 300_000, 1 << 20
#: Bits of the value, and hexadecimal digits of the item, that one histogram tells apart.
BITS, DIGITS = 10, 4
#: A share of one, what every count is raised by, and the least number of documents of a language's term.
ONE, RAISE, LEAST_DOCS = 1_000_000_000, 5, 30

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def text_terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    raw = (text or "").encode().translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it) of ``docs`` (lang, source, text); null is ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in held.items():
                terms = list(n)
                columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([rows[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                n, rows = held.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in text_terms(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                rows.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()
        forget()

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """The share of a count among ``total`` occurrences of ``terms`` terms, each raised, in billionths; whole numbers throughout."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    return 1 + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n + RAISE).cast("decimal(19,0)"), (total + RAISE * terms).cast("decimal(19,0)"))


def top_ranked(rows: DataFrame, keys: Sequence[str], value: str, item: str, k: int, scratch: Scratch, tag: str = "top") -> DataFrame:
    """Of each group of ``rows`` the ``k`` with the largest value, of equal ones those with the least item by its UTF-8 bytes, and their ``rank``.

    Values are whole numbers of 0 or more, items differ within a group, neither is null; groups with a null key are groups too. ``rows`` are
    read about a dozen times, so they should be a table."""
    at = [F.col(c) for c in keys]
    most = rows.agg(F.max(value)).first()[0]
    width = -(-max(int(most or 0).bit_length(), 1) // BITS) * BITS
    # Of each group: the high bits of its k-th largest value, and how many of the rows that have them are among the k.
    cut = scratch.save(rows.groupBy(*at).agg(F.count("*").alias("all")).where(F.col("all") > k).select(*at, F.lit(0).cast("long").alias("high"), F.lit(k).cast("long").alias("left")), f"{tag}-0")
    down = Window.partitionBy(*keys).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for step in range(width // BITS):
        shift = width - (step + 1) * BITS
        near = rows.join(cut.withColumnsRenamed({c: f"_{c}" for c in keys}), [rows[c].eqNullSafe(F.col(f"_{c}")) for c in keys]).where(F.shiftright(value, shift + BITS) == F.col("high"))
        counts = near.groupBy(*at, "left", F.shiftright(value, shift).alias("bucket")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(down))
        here = counts.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        cut = scratch.save(here.select(*at, F.col("bucket").alias("high"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"), (F.col("upto") == F.col("left")).alias("whole")), f"{tag}-{step + 1}")
    # Those equal to the k-th value: all of them, or those up to some prefix of the item's bytes.
    last = cut.where("whole").select(*at, "high", F.lit("~").alias("prefix"), F.lit(1).alias("read"))
    open_, step = cut.where("NOT whole").select(*at, "high", "left", F.lit("").alias("prefix")), 0
    digits = F.hex(F.col(item).cast("binary"))
    up = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    equal = None
    while not open_.isEmpty():
        if equal is None:
            ties = rows.join(open_.select(*(F.col(c).alias(f"_{c}") for c in keys), "high"), [*(rows[c].eqNullSafe(F.col(f"_{c}")) for c in keys), rows[value] == F.col("high")])
            equal = scratch.save(ties.select(*at, digits.alias("digits")), f"{tag}-equal")
        step += 1
        near = equal.join(open_.withColumnsRenamed({c: f"_{c}" for c in keys}), [equal[c].eqNullSafe(F.col(f"_{c}")) for c in keys]).where(F.left("digits", F.length("prefix")) == F.col("prefix"))
        counts = near.groupBy(*at, "high", "left", F.left("digits", F.lit(DIGITS * step)).alias("bucket")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(up))
        here = counts.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        done = scratch.save(here.select(*at, "high", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("bucket").alias("prefix"), (F.col("upto") == F.col("left")).alias("whole")), f"{tag}-bytes-{step}")
        last = last.unionByName(done.where("whole").select(*at, "high", "prefix", F.lit(DIGITS * step).alias("read")))
        open_ = done.where("NOT whole").select(*at, "high", "left", "prefix")
    bound = last.withColumnsRenamed({c: f"_{c}" for c in keys})
    joined = rows.join(bound, [rows[c].eqNullSafe(F.col(f"_{c}")) for c in keys], "left")
    # A tilde follows all digits. As many digits are compared as were read, as a shorter prefix is a whole item.
    first = F.left(digits, F.col("read")) <= F.col("prefix")
    taken = joined.where(F.col("high").isNull() | (F.col(value) > F.col("high")) | ((F.col(value) == F.col("high")) & first))
    # k rows of a group at most.
    return taken.select(*rows.columns).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), item)))


def _pairs(kept: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, item, value: each other source of the language, and the sum over all terms of the differences of both shares.

    With shares p and floors b of sources x and y, and only terms that occur in x or y needing a look::

        sum |px - py| = V |bx - by| + sum over x's terms (|px - by| - |bx - by|) + the same for y's
                        + sum over common terms (|px - py| - |px - by| - |bx - py| + |bx - by|)

    The sums over x's terms need its shares alone, as numbers of terms by share: by is below px, but where y is far smaller."""
    two = groups.select("lang", F.col("source").alias("x"), F.col("floor").alias("bx"), "terms").join(groups.select("lang", F.col("source").alias("y"), F.col("floor").alias("by")), "lang").where("x <> y")
    shares = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    own = shares.groupBy("lang", F.col("source").alias("x")).agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("p")).alias("sum"))
    # Terms whose share lies below another source's floor, which few do.
    most = groups.groupBy("lang").agg(F.max("floor").alias("most"))
    low = shares.join(most, "lang").where("p < most").select("lang", F.col("source").alias("x"), "p", "n")
    under = low.join(groups.select("lang", F.col("source").alias("y"), F.col("floor").alias("by")), "lang").where("p < by AND x <> y").groupBy("lang", "x", "y").agg(F.sum(F.col("n") * (F.col("by") - F.col("p"))).alias("under"))
    side = two.join(own, ["lang", "x"], "left").join(under, ["lang", "x", "y"], "left")
    gap = F.abs(F.col("bx") - F.col("by"))
    alone = F.coalesce("sum", F.lit(0)) - F.coalesce("held", F.lit(0)) * (F.col("by") + gap) + 2 * F.coalesce("under", F.lit(0))
    side = side.select("lang", "x", "y", "terms", gap.alias("gap"), alone.alias("alone"))
    # Terms that both hold: rows are summed up for each pair of sources where they are joined.
    a, b = (kept.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("floor").alias(f"b{x}")) for x in "xy")
    each = F.abs(F.col("px") - F.col("py")) - F.abs(F.col("px") - F.col("by")) - F.abs(F.col("bx") - F.col("py")) + F.abs(F.col("bx") - F.col("by"))
    common = scratch.save(a.join(b, ["lang", "term"]).where("x < y").groupBy("lang", "x", "y").agg(F.sum(each).alias("common")), "common")
    common = common.union(common.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "common"))
    side = scratch.save(side, "sides")
    other = side.select("lang", F.col("x").alias("y"), F.col("y").alias("x"), F.col("alone").alias("other"))
    both = side.join(other, ["lang", "x", "y"]).join(common, ["lang", "x", "y"], "left")
    value = F.col("terms") * F.col("gap") + F.col("alone") + F.col("other") + F.coalesce("common", F.lit(0))
    return both.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), F.when(F.col("terms") > 0, value).otherwise(0).alias("value"))


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text).

    Terms are what lies between ASCII characters that are not letters, A-Z lower-cased; a language keeps those in ``least_docs`` of its rows.
    Part ``pair``: every other source of the group's language, by the sum of the differences of their shares over all kept terms. Part
    ``term``: the ``k`` kept terms whose share in the group exceeds that in the language most. A null text, lang or source is ''; a group
    without terms has the floor for each; a language without kept terms has pairs of value 0; repeated rows count each; no rows, no result."""
    scratch = Scratch(docs.sparkSession, "divergence")
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(term), "in_lang": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    counted = scratch.save(counted.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "in_lang", "first"), "counted")
    langs = counted.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("terms"))
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = named.join(counted.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_n", "terms")))
    floor = F.when(F.col("terms") > 0, share(F.lit(0), "total", F.greatest("terms", F.lit(1)))).otherwise(0)
    groups = scratch.save(groups.withColumn("floor", floor), "groups")
    kept = counted.join(groups, ["lang", "source"]).select("lang", "source", "term", "floor", share("n", "total", "terms").alias("p"), share("in_lang", "lang_n", "terms").alias("q"))
    kept = scratch.save(kept, "kept")
    over = scratch.save(kept.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "over")
    terms = top_ranked(over, ["lang", "source"], "value", "item", k, scratch).withColumn("part", F.lit("term"))
    pairs = _pairs(kept, groups, scratch).withColumns({"part": F.lit("pair"), "rank": F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))})
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")

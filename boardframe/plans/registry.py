"""The library's operators on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardframe.functions import text
from boardframe.operators import audit, overlay, sequences, state
from boardframe.plans.catalogue import ORACLE_SQL, QUERIES, query
from boardframe.plans.generated import made, named, oracle

__all__ = ["ORACLE_SQL", "QUERIES"]

def _id_range(t) -> tuple[int, int]:
    """Least and greatest doc_id of the documents; without any, a range that holds nothing."""
    low, high = t("documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    return (0, -1) if low is None else (low, high)


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {}) WHERE k = 1"


@query(f"SELECT event_type, count(*) AS n FROM ({LATEST.format('events')}) GROUP BY 1")
def latest_per_key_counts(t):
    return state.counts(state.latest(t("events"), ["user_id"], ["ts", "event_id"]), "event_type")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def first_wins(t):
    return state.first(t("conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


ACCEPTED = ("click", "purchase")


@query(f"SELECT user_id, event_id, event_type FROM ({LATEST.format('''(SELECT * FROM events WHERE event_type IN ('click', 'purchase'))''')})")
def filter_then_latest(t):
    return state.latest_accepted(t("events"), ACCEPTED, keys=["user_id"], order=["ts", "event_id"], status="event_type").select("user_id", "event_id", "event_type")


@query(f"SELECT user_id, event_id, event_type FROM ({LATEST.format('events')}) WHERE event_type IN ('click', 'purchase')")
def latest_then_filter(t):
    return state.latest_accepted(t("events"), ACCEPTED, buried=True, keys=["user_id"], order=["ts", "event_id"], status="event_type").select("user_id", "event_id", "event_type")


@query("""
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'human' END, CASE WHEN l.quality = 1 THEN 'fix' END, d.lang) AS value,
  CASE WHEN l.toxic = 1 THEN 'override' WHEN l.quality = 1 THEN 'label' ELSE 'original' END AS source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def overlay_precedence(t):
    rows = overlay.overlay(t("documents").select("doc_id", "lang"), (t("labels").select("doc_id", "quality", "toxic"), "l_"), key="doc_id")
    human, fix = F.when(F.col("l_toxic") == 1, "human"), F.when(F.col("l_quality") == 1, "fix")
    source = F.when(human.isNotNull(), "override").when(fix.isNotNull(), "label").otherwise("original")
    return rows.select("doc_id", overlay.prefer(human, fix, F.col("lang")).alias("value"), source.alias("source"))


@query("SELECT coalesce(lang, '?') AS lang, count(*) AS n FROM documents GROUP BY 1")
def status_counts(t):
    return state.counts(t("documents"), "lang")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_ids(t):
    return state.without_done(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT k AS doc_id FROM range((SELECT min(doc_id) FROM documents), (SELECT max(doc_id) + 1 FROM documents)) r(k) WHERE k NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def expected_ids(t):
    return sequences.missing(t("labels"), "doc_id", *_id_range(t))


@query("SELECT count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def paired_ids(t):
    return overlay.paired(t("documents"), t("labels"), "doc_id")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(t):
    return sequences.duplicates(t("lineitem"), "l_partkey", "l_suppkey")


@query("""
SELECT *, missing + repeated + unnumbered = 0 AS ok FROM (SELECT
  (SELECT count(*) FROM range((SELECT min(doc_id) FROM documents), (SELECT max(doc_id) + 1 FROM documents)) r(k) WHERE k NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS missing,
  (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated,
  (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS unnumbered)""")
def coverage_gate(t):
    return sequences.gate(t("labels"), "doc_id", *_id_range(t))


@query("""
SELECT min(doc_id) AS low, CASE WHEN min(doc_id) = max(doc_id) THEN CAST(min(doc_id) AS VARCHAR) ELSE min(doc_id) || '-' || max(doc_id) END AS pages
FROM (SELECT doc_id, toxic, doc_id - row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS g FROM labels) WHERE toxic = 0 GROUP BY g""")
def page_ranges(t):
    return sequences.ranges(t("labels").where("toxic = 0"), "doc_id", ["toxic"]).drop("toxic")


@query(r"""
SELECT doc_id, coalesce(nullif(regexp_extract(source, '^\s*(\d+)', 1), ''), replace(source, '*', '')) AS key, coalesce(TRY_CAST(regexp_replace(source, '\D', '', 'g') AS BIGINT), 0) AS number,
  CAST(length(source) - length(replace(source, '*', '')) AS INTEGER) AS stars FROM documents""")
def numeric_key(t):
    s = F.col("source")
    return t("documents").select("doc_id", text.key(s).alias("key"), text.sort_number(s).alias("number"), text.stars(s).alias("stars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
SELECT l_orderkey, base, n AS votes FROM (
  SELECT l_orderkey, base, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, base) AS k FROM (
    SELECT l_orderkey, CAST(l_quantity AS BIGINT) % 5 - l_linenumber % 2 AS base, count(*) AS n, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def majority_offset(t):
    rows = t("lineitem").withColumn("base", F.col("l_quantity").cast("bigint") % 5 - F.col("l_linenumber") % 2)
    return sequences.majority(rows, "base", ["l_linenumber"], ["l_orderkey"])


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def stitch_text(t):
    return sequences.stitched(t("conversations"), "text", ["turn"], ["conv_id"])


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS carried FROM conversations""")
def carry_forward(t):
    own = F.when(F.col("role") == "user", F.length("text").cast("bigint"))
    return sequences.carry(t("conversations").select("conv_id", "turn", own.alias("own")), F.col("own"), ["turn"], ["conv_id"], "carried").select("conv_id", "turn", F.coalesce("carried", F.lit(-1)).alias("carried"))


@query("""
SELECT event_type, low, high, gap FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gap DESC, low) AS k FROM (
  SELECT event_type, value AS low, lead(value) OVER (PARTITION BY event_type ORDER BY value) AS high, high - low AS gap FROM events) WHERE high IS NOT NULL) WHERE k = 1""")
def widest_gap(t):
    return sequences.widest_gap(t("events"), "value", ["event_type"])


@query("""
SELECT user_id, min(event_id) AS low, max(event_id) AS high, count(*) AS n, CAST(floor((min(event_id) + max(event_id)) / 2) AS BIGINT) AS centre FROM (
  SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (
    SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 50 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g""")
def tolerant_runs(t):
    return sequences.runs(t("events").select("user_id", "event_id"), "event_id", ["user_id"], 50)


@query("""
SELECT user_id, coalesce(max(CASE WHEN f THEN n END), 0) AS longest FROM (SELECT user_id, f, g, count(*) AS n FROM (
  SELECT user_id, f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, f ORDER BY event_id) AS g
  FROM (SELECT *, event_type = 'click' AS f FROM events)) GROUP BY 1, 2, 3) GROUP BY 1""")
def longest_run(t):
    return sequences.longest_run(t("events"), F.col("event_type") == "click", ["event_id"], ["user_id"])


@query("""
SELECT o_custkey, (k - 1) // 2 AS pair, max(CASE WHEN k % 2 = 1 THEN o_orderkey END) AS first, coalesce(max(CASE WHEN k % 2 = 0 THEN o_orderkey END), -1) AS second
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1, 2""")
def pair_rows(t):
    return sequences.pairs(t("orders"), "o_orderkey", ["o_orderkey"], ["o_custkey"]).na.fill(-1, ["second"])


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS n, regexp_extract_all(text, '[A-Z][a-z]+')[1] AS first FROM documents")
def token_scan(t):
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    return t("documents").select("doc_id", F.size(found).alias("n"), F.try_element_at(found, F.lit(1)).alias("first"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[{}]', '''', 'g')) AS n FROM pages")
def markup_strip(t):
    return t("pages").select("page_id", F.length(text.comment_safe(F.regexp_replace("html", "<[^>]*>", ""))).cast("bigint").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, '–‑−', '---'), '\b0-0-0', 'O-O-O', 'g'), '\b0-0', 'O-O', 'g')) AS folded FROM documents")
def normalise_text(t):
    return t("documents").select("doc_id", F.md5(text.fold_moves(F.col("text"))).alias("folded"))


@query("""
SELECT count(*) AS n, CAST(sum(CASE WHEN d.text IS NOT NULL AND list_slice(regexp_extract_all(d.text, '[^ ]+'), 1, len(regexp_extract_all(b.text, '[^ ]+'))) = regexp_extract_all(b.text, '[^ ]+') THEN 1 ELSE 0 END) AS BIGINT) AS ok,
  CAST(sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3""")
def prefix_score(t):
    docs = t("documents").select("doc_id", F.col("text").alias("got"))
    both = t("benchmark").join(docs, F.col("doc_id") == F.col("item_id") * 3, "left")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    ok = audit.starts(words("got"), words("text"), F.col("got") != "")
    return both.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(F.col("doc_id").isNull()).alias("missing"))


#: A range for each order, some in others, some of length one and some very long; of several the one of least place counts.
RANGES = """ranges AS (SELECT o_orderkey * 3 AS low, o_orderkey * 3 + CASE WHEN o_orderkey % 1000 = 7 THEN 3000000000000 WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 40 END AS high, 'r' || CAST(o_orderkey AS STRING) AS name, o_custkey * 1000000 + o_orderkey AS place FROM {orders} WHERE o_orderkey % 3 > 0)"""


@query(named(oracle(RANGES), select="SELECT spot, min_by(name, place) AS name FROM (SELECT DISTINCT l_orderkey * 3 + l_linenumber AS spot FROM lineitem) JOIN ranges ON spot BETWEEN low AND high GROUP BY spot"))
def range_lookup(t):
    points = t("lineitem").select((F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("spot")).distinct()
    return overlay.in_ranges(points, made(t, named(RANGES, select="SELECT * FROM ranges")), "spot")


#: Chapters as a book's configuration has them.
CHAPTERS = {"chapters": {"1-20000": "opening", "15000-35000": "middle", "35001-900000000": "end"}}


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= 20000 THEN 'opening' WHEN o_orderkey <= 35000 THEN 'middle' ELSE 'end' END AS name FROM orders WHERE o_orderkey BETWEEN 1 AND 900000000")
def chapters(t):
    rows = t("orders").select("o_orderkey")
    return overlay.in_ranges(rows, overlay.chapters(rows.sparkSession, CHAPTERS), "o_orderkey")


@query("""
SELECT p_brand, a, b FROM (SELECT x.p_brand, x.p_partkey AS a, y.p_partkey AS b, row_number() OVER (PARTITION BY x.p_brand ORDER BY abs(x.p_retailprice - y.p_retailprice), least(x.p_partkey, y.p_partkey), greatest(x.p_partkey, y.p_partkey)) AS k
FROM part x JOIN part y ON x.p_brand = y.p_brand AND (x.p_retailprice, x.p_partkey) < (y.p_retailprice, y.p_partkey)) WHERE k = 1""")
def argmin_pair(t):
    """Of each brand the two parts of closest price: they are neighbours in the order of prices."""
    rows = t("part").select("p_brand", "p_retailprice", "p_partkey", F.struct("p_retailprice", "p_partkey").alias("own"))
    beside = sequences.carry(rows, F.col("own"), ["p_retailprice", "p_partkey"], ["p_brand"], "before", before=True).where("before IS NOT NULL")
    gap = F.col("p_retailprice") - F.col("before.p_retailprice")
    keys = F.array_sort(F.array("p_partkey", "before.p_partkey"))
    best = beside.groupBy("p_brand").agg(F.min(F.struct(gap.alias("gap"), keys.alias("keys"), F.col("before.p_partkey").alias("a"), F.col("p_partkey").alias("b"))).alias("m"))
    return best.select("p_brand", "m.a", "m.b")


@query("SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def top_fonts(t):
    rows = t("lineitem").select("l_partkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return rows.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(15)


@query("""
SELECT count(*) AS pages, round(avg(CASE WHEN contains(html, '<p>') THEN 1.0 ELSE 0.0 END), 3) AS text_fraction, CAST(sum(length(html)) AS BIGINT) AS total_chars,
  CAST(sum(CASE WHEN contains(html, '<nav>') THEN 1 ELSE 0 END) AS BIGINT) AS with_nav FROM pages""")
def doc_profile(t):
    has = lambda mark: F.col("html").contains(mark)
    return t("pages").agg(F.count("*").alias("pages"), F.round(F.avg(has("<p>").cast("double")), 3).alias("text_fraction"), F.sum(F.length("html")).alias("total_chars"), F.count_if(has("<nav>")).alias("with_nav"))


@query("""
SELECT doc_id, review, CAST(row_number() OVER (ORDER BY CASE review WHEN 'needs-review' THEN 0 WHEN 'unsolved' THEN 1 WHEN 'no-solution' THEN 2 WHEN 'verified' THEN 3 ELSE 4 END, doc_id) AS BIGINT) AS place FROM (
  SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'no-solution' WHEN l.quality = 0 AND l.toxic = 1 THEN 'unsolved' WHEN l.quality = 0 THEN 'needs-review' WHEN l.toxic = 1 THEN 'reviewed' ELSE 'verified' END AS review
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def review_queue(t):
    from boardframe.operators.review import ORDER, outcome

    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    review = outcome(F.col("quality").cast("string"), F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False)))
    rows = rows.select("doc_id", review.alias("review")).withColumn("rank", F.array_position(F.array(*map(F.lit, ORDER)), F.col("review")))
    return sequences.places(rows, "rank", "doc_id").select("doc_id", "review", "place")


@query("SELECT doc_id FROM documents WHERE source = 'src0' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def union_candidates(t):
    return t("documents").where("source = 'src0'").select("doc_id").union(t("labels").where("toxic = 1").select("doc_id")).distinct()

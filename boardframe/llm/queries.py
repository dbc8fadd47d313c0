"""The registered queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Of that vocabulary, and the id that ends a document.
VOCAB_SIZE, END_ID = 49_408, 2

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.exact_dedup import exact_dedup

    # Its contract wants a digest for every row, so one scan takes it for all; the pipeline's stage hashes survivors alone.
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True).drop("twin", "refined")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.url_filter import url_filter

    return url_filter(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over pages of which many redirect to others, in trees: decisions reach all aliases of an address."""
    from boardframe.llm.url_filter import url_filter

    pages = read(spark, sf_dir, "pages").where("url IS NOT NULL")
    target = pages.select(F.col("page_id").alias("to"), F.col("url").alias("b"))
    # Which pages redirect hangs on their own address, so it does not matter how many pages there are.
    sources = pages.where(F.length("url") % 2 == 0).select(F.floor(F.col("page_id") / 5).alias("to"), F.col("url").alias("a"))
    redirects = sources.join(target, "to").select("a", "b")
    return url_filter(pages, RULES, redirects).select("page_id", "rule", "verdict", "reason", "component")


URL_REDIRECTS_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, url, translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[\s\S]*?://[^?#]*(\?[^#]*)', 1) AS query FROM pages WHERE url IS NOT NULL),
k AS (SELECT *, CASE WHEN host <> '' THEN host || path || query END AS key FROM u),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, key, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS n FROM k JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)),
own AS (SELECT k.page_id, k.key, m.rule, m.verdict FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.n = 1),
e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b ON b.page_id = a.page_id // 5 WHERE length(a.url) % 2 = 0 AND a.key <> b.key),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, seen) AS (SELECT a, a FROM pairs UNION SELECT pairs.b, reach.seen FROM reach JOIN pairs ON pairs.a = reach.node),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1),
v AS (SELECT component, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM own JOIN c ON c.node = own.key GROUP BY 1)
SELECT own.page_id, own.rule, CASE WHEN own.verdict IS NOT NULL THEN own.verdict WHEN v.allowed THEN 'allow' WHEN v.blocked THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN own.rule IS NOT NULL THEN 'rule' WHEN v.allowed OR v.blocked THEN 'alias' ELSE 'default' END AS reason, c.component
FROM own LEFT JOIN c ON c.node = own.key LEFT JOIN v ON v.component = c.component
"""


#: The pages of these tables hold no links of their own, so no decision reaches another address.
OP8_SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT u.page_id, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC) AS k
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.token_files import token_files

    return token_files(read(spark, sf_dir, "documents"), _vocabulary(), end_id=END_ID, vocab_size=VOCAB_SIZE)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), _vocabulary(), end_id=END_ID)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: a sample of TARGET_ROWS documents at most that are labelled as good and not toxic. Raw counts and weights
    cover all documents; as many are drawn as fit the target better."""
    from boardframe.llm.importance import resample

    good = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct()
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # TARGET_ROWS numbers at most go to every task.
    return resample(docs, docs.join(F.broadcast(some), "doc_id", "left_semi"))


#: Labelled documents that the target is estimated from at most.
TARGET_ROWS = 20_000

def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.language import identify, train

    docs = read(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(third != 1).select("text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.decontaminate import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short=True).drop("twin")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.suffix_dedup import dedup_strings

    return dedup_strings(read(spark, sf_dir, "documents"), length=100).drop("spans")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.jaccard_join import similar

    return similar(read(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents"), min_chars=1)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text; a tenth of the texts, chosen by their doc_id, is made periodic from some word on first."""
    from boardframe.llm.periodic_runs import longest, repetitions

    docs = read(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", F.when(h % 10 == 0, _made_periodic(F.col("text"), F.floor(h / 10))).otherwise(F.col("text")).alias("text"))
    found = repetitions(docs).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _made_periodic(text: Column, g: Column) -> Column:
    """A text's words, of which those from word a on repeat p words of it; a text without words stays as it is."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0)).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    return F.coalesce(F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int")), " "), text)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.divergence import divergence

    return divergence(read(spark, sf_dir, "documents"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boardframe.llm.bpe import encode

    found = encode(read(spark, sf_dir, "documents"), _vocabulary(), decoded=True)
    tokens = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_language_mixture": op2_language_mixture,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_bpe_codec": op13_bpe_codec,
    "url_redirects": url_redirects,
}

#: Texts as hexadecimal digits, two for each byte.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i - 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS i FROM d WHERE length(h) >= 200)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM a)),
r AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM g GROUP BY doc_id, g),
c AS (SELECT r.doc_id, low, high, substr(h, 2 * lag(high, 1, 1) OVER o - 1, 2 * (low - lag(high, 1, 1) OVER o)) AS piece FROM r JOIN d ON d.doc_id = r.doc_id WINDOW o AS (PARTITION BY r.doc_id ORDER BY low)),
x AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS spans, string_agg(piece, '' ORDER BY low) AS kept, max(high) AS last FROM c GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 2], ' ')) AS h FROM i),
n AS (SELECT doc_id, count(*) AS n, sum(CAST(h AS HUGEINT)) AS own FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.x, c.y, nx.own <> ny.own AS other, ny.own FROM c JOIN n nx ON nx.doc_id = c.x JOIN n ny ON ny.doc_id = c.y WHERE 100 * same >= 90 * (nx.n + ny.n - same)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id),
k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1), d AS (SELECT x, count(DISTINCT own) AS n FROM l WHERE other GROUP BY 1)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(d.n, 0) AS n_links FROM k LEFT JOIN n ON n.doc_id = k.doc_id LEFT JOIN d ON d.x = k.doc_id
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, lower(trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS line, doc_id * 2147483648 + i AS place FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
f AS (SELECT line, min(place) AS first, length(line) AS n FROM r WHERE line <> '' GROUP BY 1),
p AS (SELECT a.line, min(b.first) AS near FROM f a JOIN f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first
  WHERE (left(a.line, CAST(least(a.n, b.n) // 2 AS BIGINT)) = left(b.line, CAST(least(a.n, b.n) // 2 AS BIGINT)) OR right(a.line, CAST(least(a.n, b.n) // 2 AS BIGINT)) = right(b.line, CAST(least(a.n, b.n) // 2 AS BIGINT))) AND editdist3(a.line, b.line) <= 4 AND EDITS GROUP BY 1),
k AS (SELECT r.doc_id, r.line_no, r.line, r.place, coalesce(p.near, f.first, r.place) AS best FROM r LEFT JOIN f ON f.line = r.line LEFT JOIN p ON p.line = r.line)
SELECT doc_id, line_no, best // 2147483648 AS keep_doc_id, best % 2147483648 AS keep_line_no, best = place AS kept, CASE WHEN line = '' THEN 'blank' WHEN best = place THEN 'first' ELSE 'later' END AS how FROM k
"""
# One edit: of equal length with one other character, or one character more; told by the parts before and behind the place where they part.
OP7_SQL = OP7_SQL.replace("editdist3(a.line, b.line) <= 4 AND EDITS", """CASE WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda q: a.line[q] <> b.line[q])) = 1
    ELSE len(list_filter(range(1, greatest(a.n, b.n) + 1), lambda q: CASE WHEN a.n > b.n THEN a.line[: q - 1] || a.line[q + 1 :] = b.line ELSE b.line[: q - 1] || b.line[q + 1 :] = a.line END)) > 0 END""")

#: Pairs of equal words, a row for each distance; neighbouring pairs of one distance make a run. The checksum works by a table of 256 numbers.
OP11_SQL = r"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: xor(a // 256, t[(xor(a, c) % 256)::BIGINT + 1])), 4294967295::UBIGINT) AS BIGINT) AS h
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), t),
p AS (SELECT *, a, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM (SELECT *, CASE WHEN h % 10 = 0 THEN h // 10 % n ELSE n END AS a FROM d WHERE n > 0)),
w AS (SELECT doc_id, n, i, ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM r),
x AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.i = w.i) GROUP BY 1)
SELECT d.doc_id, coalesce(x.n_runs, 0) AS n_runs, b.start, CAST(b.length AS BIGINT) AS length, b.period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(x.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS v FROM t GROUP BY 1),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN t USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2) c ON c.lang = d.lang AND c.source = d.source),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * l.v) AS p, 1 + 1000000000 * (t.n + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN t ON t.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op11_periodic_runs": OP11_SQL, "op12_source_divergence": OP12_SQL, "op4_suffix_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "url_redirects": URL_REDIRECTS_SQL}

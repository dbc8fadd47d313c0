"""URL rules whose block decisions reach redirects and canonical aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardframe.llm.components import connected_components
from boardframe.llm.store import Scratch

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

#: Rules in one plan at most; more are joined by host.
PLAN_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none or url is null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What equal addresses share: host, path and query, without scheme and fragment; null if there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def absolute(link: Column, base: Column) -> Column:
    """``link`` as seen from the page at ``base``."""
    link, top = F.replace(link, F.lit("&amp;"), F.lit("&")), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*((?:/[^/?#]*)*/)", 1)
    found = (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(top == "", None)
        .when(link.startswith("/"), F.concat(top, link))
        .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), link))
    )
    return F.when(found.rlike(r"://[^/?#]*/(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), resolved(found)).otherwise(found)


def resolved(url: Column) -> Column:
    """Without the parts ``.`` and ``..`` of its path, which stand for the folder and the one above it."""
    top, tail = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*/?([^?#]*)", 1), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    path = F.array_join(walked, "/")
    return F.concat(top, F.lit("/"), path, F.when(path == "", "").otherwise(closed), tail)


def _order(rule: Rule) -> tuple:
    """Longest first; of rules as long, the longer host, then allow, then by name."""
    return -len(rule[1] + rule[2]), -len(rule[1]), rule[0], rule[1], rule[2]


def with_rule(urls: DataFrame, rules: Sequence[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, or nulls. A rule fits its host and all subdomains."""
    ranked = sorted({(v, h.lower(), p) for v, h, p in rules}, key=_order)
    if not ranked:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(ranked) <= PLAN_RULES:
        rule = verdict = F
        for v, h, p in ranked:
            fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
            rule, verdict = rule.when(fits, h + p), verdict.when(fits, v)
        return urls.withColumns({"rule": rule, "rule_verdict": verdict})
    table = urls.sparkSession.createDataFrame([(h, p, h + p, v, i) for i, (v, h, p) in enumerate(ranked)], "suffix string, prefix string, rule string, verdict string, place int")
    labels = F.split(host, r"\.")
    parts = urls.select(host).distinct().select(host, F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    own = parts.join(table, "suffix").groupBy(host).agg(F.array_sort(F.collect_list(F.struct("place", "prefix", "rule", "verdict"))).alias("_rules"))
    first = F.try_element_at(F.filter("_rules", lambda r: F.col(path).startswith(r["prefix"])), F.lit(1))
    return urls.join(own, host, "left").withColumns({"rule": first["rule"], "rule_verdict": first["verdict"]}).drop("_rules")


def url_filter(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, reason, component.

    Addresses are nodes; all canonical links and refresh redirects in html, seen from the page's base address if it names one, and rows of
    ``redirects`` (two columns of addresses), are edges. A page's own rule decides first (reason ``rule``). Without one, an explicit allow of any alias
    comes before a block of any alias (``alias``); aliases that were never fetched count. Else the verdict is allow
    (``default``). Null or malformed urls have an empty host and path, no aliases, and are allowed; null html has no links.
    Repeated rows each get a row. component is the smallest address of the aliases, null where there are none.
    """
    scratch = Scratch(pages.sparkSession, "url")
    url, html = F.col("url"), F.col("html")
    own = with_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key")), rules)
    # Links of a page are seen from its base address, where it names one.
    found = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH)))
    links = pages.select(url, F.regexp_extract(html, BASE, 1).alias("named"), F.explode(F.array_distinct(found)).alias("link")).where("link <> ''")
    links = links.select(url, "link", F.coalesce(F.when(F.col("named") != "", absolute(F.col("named"), url)), url).alias("base"))
    edges = links.select(url.alias("a"), absolute(F.col("link"), F.col("base")).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(*(F.col(c) for c in redirects.columns[:2])))
    edges = scratch.save(edges.select(key_of(F.col("a")).alias("a"), key_of(F.col("b")).alias("b")).where("a <> b").distinct(), "edges")
    members = scratch.save(connected_components(edges, scratch), "members")

    # A node is host, path and query: with a scheme before it, it is an address again.
    node = F.concat(F.lit("x://"), "node")
    judged = with_rule(members.withColumns({"host": host_of(node), "path": path_of(node)}), rules)
    parts = judged.groupBy("component").agg(F.bool_or(F.coalesce(F.col("rule_verdict") == "allow", F.lit(False))).alias("allowed"), F.bool_or(F.coalesce(F.col("rule_verdict") == "block", F.lit(False))).alias("blocked"))
    aliases = members.join(parts, "component").select(F.col("node").alias("key"), "component", "allowed", "blocked")
    # Pages without an address have no aliases, and do not meet in one task for want of a key.
    bare = own.where("key IS NULL").select(*own.columns, *(F.lit(None).cast(t).alias(c) for c, t in (("component", "string"), ("allowed", "boolean"), ("blocked", "boolean"))))
    found = own.where("key IS NOT NULL").join(aliases, "key", "left").select(*own.columns, "component", "allowed", "blocked").union(bare)
    alias = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", alias, F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default").alias("reason"), "component")

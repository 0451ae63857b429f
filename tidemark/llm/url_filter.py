"""URL filters: host and path rules, with decisions carried over redirects and canonical links. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, cut


class Rule(NamedTuple):
    """Fits a host and all its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without :// or url."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without :// or url."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Of equally long ones an allow wins, then the longer host.

    Rules given as a list become one CASE expression in that order, so a scan needs no join.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", -len(r.host), r.name))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def best_rule_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (verdict, host, path) of any size: adds `best` to urls with columns key (unique), host, path.

    Each host is looked up under all its suffixes by an equi-join on the host; Spark picks the join.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    near = urls.select("key", "path", F.explode(suffixes).alias("h"))
    r = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").where("h <> ''").distinct()
    hits = near.join(r, "h").where(F.col("path").startswith(F.col("p")))
    rank = F.struct(F.length(F.concat("h", "p")), F.when(F.col("verdict") == "allow", 1).otherwise(0), F.length("h"))
    won = hits.groupBy("key").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), rank).alias("best"))
    return urls.join(won, "key", "left")


def node_of(url: Column) -> Column:
    """What a url is known by among links: without its fragment, A-Z in scheme and host in lower case."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"^[^:/?#]+://[^/?#]*", 0)
    return F.concat(F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(bare, F.length(head) + 1, F.length(bare)))


def _without_dots(path: Column) -> Column:
    """A path that starts with / without . and .. segments."""
    parts = F.split(path, "/")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolved(base: Column, ref: Column) -> Column:
    """A reference in a page at base as an absolute url without fragment; null if it is of another kind (mailto: and the like) or base isn't absolute."""
    ref = F.substring_index(ref, "#", 1)
    bare = F.substring_index(base, "#", 1)
    scheme, root = F.regexp_extract(bare, r"^([^:/?#]+)://", 1), F.regexp_extract(bare, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(bare, r"^[^:/?#]+://[^/?#]*([^?]*)", 1)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    near = F.when(ref.startswith("/"), ref).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), ref))
    at, query = F.regexp_extract(near, r"^[^?]*", 0), F.regexp_extract(near, r"\?.*$", 0)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.contains(ref, F.lit("://")), ref))
        .when(root == "", None)
        .when(ref == "", bare)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("?"), F.concat(root, path, ref))
        .otherwise(F.concat(root, _without_dots(at), query))
    )


def links_in(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from pages to where they say they live: all their canonical links and refresh redirects, as node_of() has them.

    rel is a list of words, one of which is canonical. Relative targets, those of another host too, are resolved against the
    page's url, and &amp; is decoded. A url's fragment is not part of its node, so it needs no edge.
    """
    quoted = lambda name: rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = lambda tag, name: F.concat(*[F.regexp_extract(tag, quoted(name), g) for g in (1, 2, 3)])
    tags = lambda kind: F.regexp_extract_all(html, F.lit(rf"(?is)<{kind}\b[^>]*>"), F.lit(0))
    none = F.array().cast("array<string>")
    # most pages have neither word, and a plain search is far cheaper than the patterns
    canonical = F.transform(F.filter(tags("link"), lambda t: value(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: value(t, "href"))
    refresh = F.transform(F.filter(tags("meta"), lambda t: value(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")), lambda t: F.regexp_extract(value(t, "content"), r"""(?i)\burl\s*=\s*['"]?\s*([^'"\s]+)""", 1))
    found = lambda word, refs: F.when(F.col(html).rlike(f"(?i){word}"), refs).otherwise(none)
    refs = F.concat(found("canonical", canonical), found("http-equiv", F.filter(refresh, lambda r: r != "")))
    each = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(F.col(url).alias("u"), F.explode(refs).alias("ref"))
    plain = F.trim(F.replace(F.replace(F.replace("ref", F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&")), F.lit("&#x26;"), F.lit("&")))
    return each.select(node_of(F.col("u")).alias("a"), node_of(resolved(F.col("u"), plain)).alias("b")).where("b is not null and a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to (other columns of) pages.

    A url that a rule fits gets that rule's verdict. Any other url gets the decision of its redirect
    equivalence class, the connected component of its node (see node_of()) over `edges` (a, b: redirects and canonical
    links between urls): allow if a rule allows any member, block if one blocks any and none allows, else
    the default. Null urls and urls without :// have empty host and path, no rule and, unless an edge says otherwise, the default verdict.
    Repeated urls get equal verdicts; edges with a null end are ignored; urls of any length are taken whole; columns of pages named host, path, rule or
    verdict are replaced; an empty table gives an empty table.
    """
    rows = pages.select(F.struct("*").alias("row"), F.col(url).alias("u_url"))
    rows = rows.withColumn("host", host_of(F.col("u_url"))).withColumn("path", path_of(F.col("u_url")))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    own = F.col("best")["verdict"]
    if edges is None:
        rows = rows.withColumn("passed_on", F.lit(None).cast("string"))
    else:
        members = cut(connected_components(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))))
        m = members.withColumn("v", best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
        ruled = m.groupBy("component").agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1)).alias("d")).where("d is not null")
        passed = members.join(ruled, "component").select(F.col("node").alias("m_url"), F.when(F.col("d") == 2, "allow").otherwise("block").alias("passed_on"))
        rows = rows.join(passed, node_of(F.col("u_url")) == F.col("m_url"), "left").drop("m_url")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return rows.select(*[F.col("row")[c].alias(c) for c in keep], "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(own, "passed_on", F.lit(default)).alias("verdict"))

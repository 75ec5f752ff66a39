"""URL filter: host/path rules, and block decisions that reach redirect aliases.

Every url gets the longest rule that fits.  For urls without a rule, redirect
and canonical-link edges join urls into components, found by distributed
star-contraction; a component with an allowed url is allowed, else one with a
blocked url is blocked.  Urls outside any component are allowed.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint
from .components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"
#: Up to so many rules become one CASE expression; more are joined.
MAX_RULES = 200


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    Of rules with the same host and path, an allow comes before a block.
    """
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if found is None else found.otherwise(none)


def matched_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``urls`` (with columns ``host`` and ``path``) and the struct ``_rule`` of the longest rule that fits.

    Few rules are one expression.  Many are a table, met by equality on each
    host suffix and on a path's beginnings of the lengths that rules have; both
    sides are aggregated to distinct (host, path) before they meet.
    """
    if len(rules) <= MAX_RULES:
        return urls.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    table = urls.sparkSession.createDataFrame([(v, h, p) for v, h, p in rules], "v string, _h string, _p string")
    sizes = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})])
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    tried = places.select("host", "path", F.explode(suffixes).alias("_h"), starts.alias("_s")).select("host", "path", "_h", F.explode("_s").alias("_p"))
    rank = F.struct((-F.length("_h") - F.length("_p")).alias("n"), (F.col("v") != "allow").alias("w"), "_h", "_p", F.col("v").alias("verdict"))
    best = tried.join(table, ["_h", "_p"]).groupBy("host", "path").agg(F.min(rank).alias("b"))
    found = best.select("host", "path", F.struct(F.concat("b._h", "b._p").alias("rule"), "b.verdict").alias("_rule"))
    return urls.join(found, ["host", "path"], "left")


def _resource(url: Column) -> Column:
    """A url without its fragment; the node of a page."""
    return F.regexp_extract(url, r"(?s)^([^#]*)", 1)


def _resolved(link: Column, url: Column) -> Column:
    """A link as found in a page, made absolute."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, origin = F.regexp_extract(url, r"(?s)^(.*?):", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*(?=/))?)", 1)
    absolute = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )
    return F.when(F.length(link) > 0, _resource(absolute))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst``: declared canonical links and meta redirects, as urls without fragment."""
    url, html = F.col(url_col), F.col(html_col)
    low = F.lower(html)
    seen = pages.where(url.contains("://") & (low.contains("canonical") | low.contains("refresh")))
    links = F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    found = seen.select(url.alias("_url"), F.explode(F.array_distinct(links)).alias("_link"))
    return found.select(_resource(F.col("_url")).alias("src"), _resolved(F.col("_link"), F.col("_url")).alias("dst")).where("dst is not null and dst != src").distinct()


def url_filter(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per page: id, ``host, path, rule, verdict, alias_root``.

    ``redirects``: further edges with columns ``src`` and ``dst`` (urls).

    Defined cases: a null url, or one without ``://``, has an empty host and
    path and no aliases; repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    judged = matched_rules(
        pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.when(url.contains("://"), F.unhex(F.md5(_resource(url)))).alias("_node")),
        rules,
    )
    edges = None
    if html_col:
        edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(_resource(F.col("src")).alias("src"), _resource(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("binary").alias("alias_root"))
    edges = checkpoint(edges)
    hashed = edges.select(F.unhex(F.md5("src")).alias("a"), F.unhex(F.md5("dst")).alias("b"))
    parts = connected_components(hashed, "a", "b")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_url")).distinct()
    ruled = matched_rules(ends.select(F.unhex(F.md5("_url")).alias("node"), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")), rules).select("node", F.col("_rule.verdict").alias("_v"))
    decided = (
        parts.join(ruled, "node")
        .groupBy("root")
        .agg(F.max((F.col("_v") == "allow").cast("int")).alias("_a"), F.max((F.col("_v") == "block").cast("int")).alias("_b"))
        .select("root", F.when(F.col("_a") == 1, "allow").when(F.col("_b") == 1, "block").alias("_alias"))
    )
    aliases = parts.join(decided, "root").select(F.col("node").alias("_node"), "root", "_alias")
    return judged.join(aliases, "_node", "left").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "_alias", F.lit(default)).alias("verdict"),
        F.col("root").alias("alias_root"),
    )

"""URL filters: longest-match rules, and decisions that reach a URL's aliases.

Redirects and canonical links are edges between URLs; their connected components are aliases of one another.  A URL that no
rule fits takes its component's decision: allow if a rule allows one of the aliases, else block if a rule blocks one,
else allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.storage import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query; a rule table is configuration and is compiled into one expression.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; equally long rules are tried in the order given."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """A URL as a graph node: without scheme and fragment, host lower-cased; null where there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _without_dots(path: Column) -> Column:
    """A path, which starts with a slash, without the segments ``.`` and ``..``."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.array_append(done, x)),
    )
    end = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def _absolute(link: Column, base: Column) -> Column:
    """``link`` as seen from the page ``base``; null for other schemes, such as mailto, and for fragments."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    path, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)?[^/]*$", 1))
    return (
        F.when(path.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes from all canonical links and refresh redirects in ``html``; relative links are resolved at the page's URL."""
    html = F.col("html")
    found = pages.where(html.rlike("(?i)canonical|http-equiv"))
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    canonical_tags = tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>")
    refresh_tags = tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>")
    links = F.concat(
        F.transform(canonical_tags, lambda tag: F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refresh_tags, lambda tag: F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    pairs = found.select("url", F.explode(links).alias("link")).where("link <> ''")
    return pairs.select(node_of(F.col("url")).alias("src"), node_of(_absolute(F.regexp_replace("link", "&amp;", "&"), F.col("url"))).alias("dst")).where("src is not null and dst is not null")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``redirects`` may hold further (src, dst) URLs.  Null urls and urls without ``://`` have empty host and path, no rule
    and no aliases.  Null html has no links; whole pages are read, however long, and equal links count once.  Repeated rows are judged alike, and an empty
    table stays empty.  Columns of ``pages`` with one of the new names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "_node", "_own")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    # Written once: the components refer to the edges more than once, and html is large.
    members = connected_components(checkpoint(edges.distinct()))
    # A node is host + path + query; rules apply to aliases that aren't pages too.
    as_url = F.concat(F.lit("x://"), F.col("id"))
    decided = members.select("id", "component", best_rule(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
    classes = decided.groupBy("component").agg(F.when(F.bool_or(F.coalesce(F.col("v") == "allow", F.lit(False))), "allow").when(F.bool_or(F.coalesce(F.col("v") == "block", F.lit(False))), "block").alias("_class"))
    by_node = members.join(classes, "component").select(F.col("id").alias("_node"), "_class")
    own = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_node": node_of(F.col("url"))})
    own = own.withColumn("_own", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_own")["verdict"], F.col("_class"), F.lit("allow"))
    return own.join(by_node, "_node", "left").withColumns({"rule": F.col("_own")["rule"], "verdict": verdict}).drop("_node", "_own", "_class")

"""URL filtering by rules, with decisions carried over redirects and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise
from corpusloom.llm.components import connected_components

#: (action, host, path): the rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(_after_scheme(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host`` + ``path``) and its action, both null where none fits.

    Of rules of equal length an allowing one goes first. ``rules`` is configuration: at most 500.
    """
    if len(rules) > 500:
        raise ValueError("more than 500 rules: join them as a table")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(under)
        name, action = F.when(fits, at + under).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def canonical_form(url: Column) -> Column:
    """Where a site sends the usual variants of an address: https, no ``www.`` or ``m.``, no query, fragment, ``.html`` or final slash."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"\.html$", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def resolved(target: Column, base: Column) -> Column:
    """The target as an absolute address, read against ``base`` by RFC 3986; null without a host."""
    root = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    full = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(root, "//", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(F.substring_index(base, "#", 1), target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    parts = r"^([^/?#]*://[^/?#]+)([^?#]*)(.*)$"
    steps = F.split(F.regexp_replace(F.regexp_extract(full, parts, 2), r"/(\.\.?)$", "/$1/"), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    return F.when(full.rlike(parts), F.concat(F.regexp_extract(full, parts, 1), F.array_join(walk, "/"), F.regexp_extract(full, parts, 3)))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``src, dst`` from pages: canonical form, ``<link rel=canonical>`` and ``<meta refresh>``.

    Targets are read against the page's url, or its ``<base href>``, and are tied to their own
    canonical forms; those without a host are left out. A page without such tags, or with a null
    body, gives its canonical form only; a null url gives no edge from it.
    """
    url, html = F.col(url_col), F.col(html_col)
    near = lambda word, tag, value: F.when(F.instr(F.lower(html), word) > 0, F.regexp_extract(F.regexp_extract(html, tag, 0), value, 1))
    link = near("canonical", r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    meta = near("refresh", r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)")
    base = near("<base", r"(?i)<base\b[^>]*\bhref\b[^>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    found = pages.select(url.alias("src"), F.nullif(base, F.lit("")).alias("base"), F.array_compact(F.array(F.nullif(link, F.lit("")), F.nullif(meta, F.lit("")))).alias("written"))
    own = F.coalesce(F.when(F.col("base").isNotNull(), resolved(F.col("base"), F.col("src"))), F.col("src"))
    ends = found.select("src", F.array_compact(F.transform("written", lambda t: resolved(t, own))).alias("ends"))
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    edges = F.concat(F.array(edge(F.col("src"), canonical_form(F.col("src")))), F.transform("ends", lambda t: edge(F.col("src"), t)), F.transform("ends", lambda t: edge(t, canonical_form(t))))
    return ends.select(F.explode(edges).alias("e")).select("e.src", "e.dst").where("src <> dst")


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: ``page_id, host, path, rule, verdict``.

    A rule that fits the url itself decides. Where none fits, the url takes the decision of its
    component of redirect and canonical-link edges: allow if a rule allows any address of it, else
    block if a rule blocks any, else allow. Addresses that only the edges name count too.

    A null url or one without ``://`` has an empty host and path and is allowed unless edges tie
    it to a blocked address. Repeated urls are judged alike; edges with null ends are ignored. No
    rows give no rows. Further columns are not read.
    """
    own_url, found = F.col(url_col), pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rule, action = rule_of(url_host(F.col("url")), url_path(F.col("url")), rules)
    judged = found.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), rule.alias("rule"), action.alias("own"))
    if edges is None:
        edges = pages.select(own_url.alias("src"), canonical_form(own_url).alias("dst"))
    nodes = connected_components(edges)
    _, node_action = rule_of(url_host(F.col("node")), url_path(F.col("node")), rules)
    marks = nodes.select("component", F.coalesce(node_action == "allow", F.lit(False)).alias("a"), F.coalesce(node_action == "block", F.lit(False)).alias("b"))
    decided = marks.groupBy("component").agg(F.when(F.max("a"), "allow").when(F.max("b"), "block").alias("spread")).where("spread IS NOT NULL")
    spread = materialise(nodes.join(decided, "component").select(F.col("node").alias("url"), "spread"), "spread")
    return judged.join(spread, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))

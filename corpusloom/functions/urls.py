"""Column expressions over page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(raw: Column, domain: str = "example.org") -> Column:
    """https, lower-case ``www.`` host, no user, port, query, fragment or final slash; null for foreign addresses.

    The path keeps its case and a bare host its root. Surrounding blanks are dropped.
    """
    url = F.trim(raw)
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?(?=[/?#]|$)", 1))
    path = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    short = F.regexp_replace(path, "/+$", "")
    out = F.concat(F.lit(f"https://www.{domain}"), F.when(short == "", "/").otherwise(short))
    return F.when(host.isin(domain, f"www.{domain}") & ~path.contains("://"), out)


def content_hash(body: Column) -> Column:
    """sha256 of a body in lower-case hex; null for null."""
    return F.sha2(body, 256)

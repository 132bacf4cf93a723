"""Fields, links and attachments of page payloads, and backfills of columns made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.html import bodies_text
from corpusloom.functions.urls import canonical_url

_ITEM = "array<struct<base_path: string>>"
_ORG = "array<struct<content_id: string, base_path: string>>"
_FILE = "array<struct<attachment_type: string, url: string, body: string>>"
SCHEMA = f"base_path string, details struct<body: string, parts: array<struct<slug: string, body: string>>, attachments: {_FILE}>, links struct<children: {_ITEM}, primary_publishing_organisation: {_ORG}, organisations: {_ORG}>"
_PAIRS = "array<struct<content_type: string, content: string>>"


def read(payload: Column) -> Column:
    """The payload's parts that are used here; all null for bad JSON."""
    return F.from_json(payload, SCHEMA)


def bodies(payload: Column) -> Column:
    """The HTML of the body and of the parts, in order; those without any left out."""
    p = read(payload)
    return _filled(F.concat(F.array(p["details"]["body"]), _bodies_of(p["details"]["parts"])))


def blobs(payload: Column) -> Column:
    """The HTML of the body, the parts and the HTML attachments, in order.

    A body may also be a list of texts with content types, of which those ending in html count.
    """
    p = read(payload)
    files = F.filter(p["details"]["attachments"], lambda f: f["attachment_type"] == "html")
    every = _filled(F.concat(F.array(p["details"]["body"]), _bodies_of(p["details"]["parts"]), _bodies_of(files)))
    parts = lambda b: F.transform(F.filter(F.from_json(b, _PAIRS), lambda x: x["content_type"].endswith("html")), lambda x: x["content"])
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(every, lambda b: F.when(F.ltrim(b).startswith("["), F.coalesce(parts(b), none)).otherwise(F.array(b))))


def _bodies_of(items: Column) -> Column:
    return F.coalesce(F.transform(items, lambda x: x["body"]), F.array().cast("array<string>"))


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda b: F.coalesce(b, F.lit("")) != "")


def body_text(payload: Column) -> Column:
    """Plain text of the body and the parts, joined by blanks; empty for bad JSON."""
    return bodies_text(bodies(payload))


def absolute(path: Column, domain: str) -> Column:
    """A path on ``domain``, or an address, in canonical form; null if it is foreign or null."""
    return canonical_url(F.when(path.startswith("/"), F.concat(F.lit(f"https://www.{domain}"), path)).otherwise(path), domain)


def html_attachments(payload: Column, domain: str = "example.org") -> Column:
    """Canonical urls of the HTML attachments, in order, each once; foreign ones dropped."""
    files = F.coalesce(read(payload)["details"]["attachments"], F.from_json(F.lit("[]"), _FILE))
    return F.array_distinct(F.array_compact(F.transform(F.filter(files, lambda f: f["attachment_type"] == "html"), lambda f: absolute(f["url"], domain))))


def child_links(pages: DataFrame, domain: str = "example.org") -> DataFrame:
    """``url, child, relation`` of children, parts and HTML attachments, each once; the page itself and foreign pages are left out.

    Parts lie below the payload's base path, or below the page's url where it has none.
    """
    p = read(F.col("payload"))
    link = lambda target, kind: F.struct(target.alias("child"), F.lit(kind).alias("relation"))
    base = F.regexp_replace(F.coalesce(F.nullif(p["base_path"], F.lit("")), F.regexp_replace("url", "^https?://[^/]*", "")), "/+$", "")
    children = F.transform(p["links"]["children"], lambda c: link(absolute(c["base_path"], domain), "child"))
    parts = F.transform(p["details"]["parts"], lambda c: link(absolute(F.concat(base, F.lit("/"), c["slug"]), domain), "part"))
    files = F.transform(html_attachments(F.col("payload"), domain), lambda u: link(u, "attachment"))
    none = F.filter(files, lambda _: F.lit(False))
    links = F.concat(F.coalesce(children, none), F.coalesce(parts, none), files)
    return pages.select("url", F.explode(F.array_distinct(links)).alias("l")).select("url", "l.child", "l.relation").where("child <> url")


def file_count(payload: Column) -> Column:
    """Attachments that are files and no pages; 0 for bad JSON."""
    files = F.coalesce(read(payload)["details"]["attachments"], F.from_json(F.lit("[]"), _FILE))
    return F.size(F.filter(files, lambda f: f["attachment_type"] == "file"))


def backfill_search_text(pages: DataFrame, rescan: bool = False) -> DataFrame:
    """``search_text`` made from the payload where it is missing, or everywhere with ``rescan``; bad JSON gives an empty text."""
    made = body_text(F.col("payload"))
    return pages.withColumn("search_text", made if rescan else F.coalesce("search_text", made))


def organisations(payload: Column) -> Column:
    """Primary and related organisations as an array of ``content_id, slug, role``, each content id once for a role, the first counting."""
    p = read(payload)
    slug = lambda path: F.regexp_extract(F.coalesce(path, F.lit("")), "([^/]*)/*$", 1)
    of = lambda items, role: F.coalesce(F.transform(items, lambda o: F.struct(o["content_id"].alias("content_id"), slug(o["base_path"]).alias("slug"), F.lit(role).alias("role"))), F.array().cast("array<struct<content_id: string, slug: string, role: string>>"))
    every = F.concat(of(p["links"]["primary_publishing_organisation"], "primary"), of(p["links"]["organisations"], "related"))
    key = lambda o: F.concat_ws("|", o["role"], F.coalesce(o["content_id"], F.lit("")))
    return F.filter(every, lambda o, i: F.array_position(F.transform(every, key), key(o)) == i + 1)


def page_organisations(pages: DataFrame) -> DataFrame:
    """``url, content_id, organisation_slug, role`` of the payload's organisations; bad JSON has none."""
    return pages.select("url", F.explode(organisations(F.col("payload"))).alias("o")).select("url", "o.content_id", F.col("o.slug").alias("organisation_slug"), "o.role")


def organisation_counters(pages: DataFrame) -> DataFrame:
    """One row ``scanned, pages_with_orgs, org_links, bad_json`` of a rebuild over all payloads; null payloads are not scanned."""
    n = F.size(organisations(F.col("payload")))
    bad = F.try_parse_json("payload").isNull()
    return pages.where("payload IS NOT NULL").agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(n > 0, 1)).alias("pages_with_orgs"), F.coalesce(F.sum(n), F.lit(0)).alias("org_links"), F.count(F.when(bad, 1)).alias("bad_json"))


def unresolved(redirects: DataFrame, resolved: DataFrame) -> DataFrame:
    """``url`` of redirect pages that have no resolved row, each once."""
    return redirects.select("url").distinct().join(resolved.select(F.col("src").alias("url")), "url", "left_anti")


def upsert_redirects(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Redirects (``src, dst, status``) with the new ones over the stored ones of the same source."""
    return stored.join(new.select("src"), "src", "left_anti").unionByName(new)


def mirror_redirects(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (``url, destination``) with the final target of the new redirects that start at them; the others keep theirs."""
    met = pages.join(new.select(F.col("src").alias("url"), F.struct("dst").alias("new")), "url", "left")
    return met.select("url", F.when(F.col("new").isNotNull(), F.col("new.dst")).otherwise(F.col("destination")).alias("destination"))


def fill_search_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Content id, title and type of search rows from the corpus where theirs are missing or empty."""
    p = pages.select("url", F.col("content_id").alias("c"), F.col("title").alias("t"), F.col("document_type").alias("d"))
    own = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(other)).alias(c)
    return rows.join(p, "url", "left").select("url", own("content_id", "c"), own("title", "t"), own("document_type", "d"))


def fill_spec(runs: DataFrame, categories: DataFrame, fields: list[str], asof: str) -> DataFrame:
    """``run_id, spec, state``: JSON settings of runs with the missing ``fields`` filled from their category as it is now.

    What a run has, even empty, is never changed. Filled specs say so, with the keys and the time.
    State is already_complete, no_category (left as it is) or backfilled; bad JSON counts as empty.
    """
    held = F.coalesce(F.from_json("spec", "map<string, string>"), F.create_map().cast("map<string, string>"))
    met = runs.select("run_id", "category_id", "spec").join(categories.select("category_id", *fields, F.lit(True).alias("there")), "category_id", "left").withColumn("held", held)
    given = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))
    missing = F.filter(F.array(*map(F.lit, fields)), lambda k: ~F.map_contains_key("held", k))
    note = F.create_map(F.lit("criteria_backfilled"), F.lit("true"), F.lit("criteria_backfilled_from"), F.lit("category_current"), F.lit("criteria_backfilled_at"), F.lit(asof), F.lit("criteria_backfilled_keys"), F.array_join(F.array_sort("missing"), ","))
    state = F.when(F.size("missing") == 0, "already_complete").when(F.col("there").isNull(), "no_category").otherwise("backfilled")
    keep = F.filter(F.map_keys("held"), lambda k: ~k.startswith("criteria_backfilled"))
    old = F.map_from_arrays(keep, F.transform(keep, lambda k: F.element_at("held", k)))
    out = met.withColumn("missing", missing).withColumn("state", state)
    filled = F.map_concat(F.map_filter(given, lambda k, _: F.array_contains("missing", k)), old, note)
    return out.select("run_id", F.when(F.col("state") == "backfilled", F.to_json(filled)).otherwise(F.col("spec")).alias("spec"), "state")


def votes_of_labels(labels: DataFrame, votes: DataFrame, labeller: str) -> DataFrame:
    """One vote of ``labeller`` for each label whose page has no vote yet."""
    return labels.join(votes.select("url"), "url", "left_anti").select("url", F.lit(labeller).alias("labeller"), "label")


def scope_list(raw: DataFrame, pages: DataFrame, domain: str = "example.org") -> DataFrame:
    """``scope, urls, usable``: distinct canonical urls of each scope and how many are in ``pages``."""
    listed = raw.select("scope", canonical_url(F.col("raw"), domain).alias("url")).where("url IS NOT NULL").distinct()
    met = listed.join(pages.select("url", F.lit(1).alias("there")).distinct(), "url", "left")
    return met.groupBy("scope").agg(F.count(F.lit(1)).alias("urls"), F.count("there").alias("usable"))

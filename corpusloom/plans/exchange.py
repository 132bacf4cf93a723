"""Queries over sinks, sources and streams: written, read again, and checked by SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from corpusloom.functions.numbers import rounded
from corpusloom.operators import export, filters, reports
from corpusloom.plans import corpus
from corpusloom.plans import evaluation as ev
from corpusloom.plans.evaluation import _REP, repeats
from corpusloom.plans.roles import ASOF, CONTENT, GOLD, ORGS, content, gold, organisations, table
from corpusloom.plans.selection import ORACLE_SQL as _SEL
from corpusloom.plans.selection import ORG, TYPE, WORDS
from corpusloom.sources import bundles, readers, writers
from corpusloom.sources.scratch import checkpoint_dir
from corpusloom.streaming import streams


def _path(s):
    return f"{checkpoint_dir(s)}/export-{uuid.uuid4().hex}"


def snk_export_fields(s, d):
    """Two runs' exports in one file; the second has no size."""
    path, pages = _path(s), content(s, d).where(filters.is_usable())
    runs = {"r1": export.export(pages, organisations(s, d), ["document_type", "nonsense", "size"], ASOF, limit=None), "r2": export.export(pages.where("doc_id % 3 = 0"), organisations(s, d), ["document_type", "primary_org"], ASOF, limit=None)}
    writers.write_table(export.stacked(runs), path, "csv")
    return s.read.schema("run_id string, url string, document_type string, size long, primary_org string").csv(path, header=True, escape='"')


def snk_label_sheet(s, d):
    path = _path(s)
    rows = gold(s, d).withColumn("rationale", F.when(F.col("doc_id") % 2 == 0, 'said "yes",\nthen'))
    writers.write_label_sheet(rows, path, ["url", "label", "rationale"])
    return readers.read_label_sheet(s, path).select("url", "label", F.coalesce("rationale", F.lit("")).alias("rationale"))


def snk_audit_export(s, d):
    path = _path(s)
    writers.write_audit(reports.audit(content(s, d).where(filters.is_usable(withdrawn=True)), organisations(s, d), ORG, TYPE, WORDS), path)
    return s.read.parquet(path).select("url", F.col("outcome").cast("string").alias("outcome"))


def shared_tables(s, d):
    """Tables of 25 categories: runs, results, members, counts, audits, pages and organisations."""
    k, docs, runs = F.col("doc_id"), content(s, d), ev.run_table(s, d)
    edges = s.createDataFrame([("en", "sub-en"), ("top", "even"), ("far", "away")], "parent string, child string")
    return {
        "categories": table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("name"), F.lit("first").alias("owner")),
        "runs": runs.select("run_id", F.col("category_id").cast("long"), "phase"), "results": docs.select((k % 40 + 1).alias("run_id"), "url", (k % 2).alias("keep")), "membership": docs.where(k % 2 == 0).select((k % 25).alias("category_id"), "content_id", "url"),
        "counts": s.range(25).select(F.col("id").alias("category_id"), (F.col("id") * 2).alias("n")), "audit": docs.where(k % 3 == 0).select((k % 25).alias("category_id"), "url", F.lit("included").alias("outcome")),
        "pages": docs.select("url", "title"), "page_organisations": organisations(s, d), "hierarchy": edges, "organisations": organisations(s, d).select(F.col("organisation_slug").alias("slug")).union(edges.select("parent")).union(edges.select("child")).distinct(),
    }


def _sizes(tables, *more):
    """Rows of each table, and what else is told of it."""
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), *[f(name, df) for f in more]) for name, df in tables.items()]
    return reduce(lambda a, b: a.union(b), parts)


def snk_bundle(s, d):
    """A category with all that it refers to, written as a unit; the sizes of its tables as they are read again."""
    path = _path(s)
    bundle = bundles.collect(shared_tables(s, d), 3)
    bundles.write(bundle, path)
    return _sizes({name: s.read.parquet(f"{path}/{name}") for name in bundle})


def src_bundle(s, d):
    """A bundle taken in twice, where the category has other members and results and some shared rows are older or missing."""
    path, tables = _path(s), shared_tables(s, d)
    bundles.write(bundles.collect(tables, 3), path)
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    here = tables | {"pages": tables["pages"].where(k % 5 != 0).withColumn("title", F.lit("old")), "membership": tables["membership"].withColumn("category_id", F.when(k % 10 == 4, 3).otherwise(F.col("category_id")).cast("long")), "results": tables["results"].withColumn("keep", F.lit(7).cast("long")), "organisations": tables["organisations"].where("slug <> 'en'")}
    twice = bundles.take_in(s, path, bundles.take_in(s, path, here, "second"), "second")
    mine = lambda name, df: F.count(F.when(F.col("owner") == "second", 1) if name == "categories" else F.when(F.col("title") != "old", 1) if name == "pages" else F.when(F.col("keep") != 7, 1) if name == "results" else F.lit(None)).alias("fresh")
    return _sizes(twice, mine)


def legacy(s, d):
    docs, k = table(s, d, "documents"), F.col("doc_id")
    pages = corpus.raw_urls(s, d).select(F.col("raw").alias("url"), F.when(k % 9 != 0, F.col("text")).otherwise("").alias("content"), F.when(k % 8 == 0, "redirect").otherwise("guidance").alias("document_type"), F.concat(F.lit("t"), k).alias("title"), "doc_id")
    sitemap = docs.where(k % 2 == 0).select(F.concat(F.lit("https://example.org/d/"), k, F.lit("/")).alias("url"), F.concat(F.lit("2026-"), k % 12).alias("lastmod")).union(docs.where(k % 50 == 0).select(F.lit("nowhere"), F.lit(None)))
    return pages, sitemap


def src_legacy_import(s, d):
    target = table(s, d, "documents").where("doc_id % 7 = 0").select(F.concat(F.lit("https://www.example.org/d/"), "doc_id").alias("url"))
    return readers.legacy_rows(*legacy(s, d), target, order="doc_id").drop("content")


def t_fetch_health(s, d):
    log = streams.read_stream(s, d, "events.parquet", table(s, d, "events").schema)
    return streams.drain(streams.fetch_health(log)).select(F.to_date("start").alias("day"), "event_type", "n")


def t_error_share(s, d):
    log = streams.read_stream(s, d, "events.parquet", table(s, d, "events").schema)
    return streams.drain(streams.error_share(log)).select(F.to_date("start").alias("day"), "n", "errors", rounded("share", 9).alias("share"))


def t_run_totals(s, d):
    """Verdicts in three files, half of them twice."""
    path, rows = _path(s), repeats(s, d).withColumn("cost", F.col("ms") / 1000.0)
    rows.unionByName(rows.where("doc_id % 2 = 0")).repartition(3).write.parquet(f"{path}/verdicts")
    verdicts = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/verdicts")
    return streams.keep_run_totals(verdicts, f"{path}/totals").newest(["run_id"]).withColumn("cost", rounded("cost", 6))


def src_org_registry(s, d):
    """Registry files of 500 organisations each, written and read again, with the number of children."""
    k, name = F.col("c_custkey"), lambda n: F.concat(F.lit("c-"), (F.col("c_custkey") + n).cast("string"))
    org = F.struct(
        F.when(k % 3 != 0, name(0)).alias("slug"), F.concat(F.lit("https://www.example.org/organisations/"), name(0), F.lit("/")).alias("link"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("C"), k)).alias("acronym"),
        F.when(k % 5 == 0, F.array(name(1), name(2))).alias("child_organisations"), F.when(k % 5 < 3, F.array(name(-1))).alias("parent_organisations"),
    )
    files = table(s, d, "customer").groupBy(F.floor(k / 500)).agg(F.collect_list(F.struct(org.alias("value"))).alias("options"))
    path = _path(s)
    files.select(F.to_json(F.struct(F.struct(F.struct("options").alias("organisations")).alias("aggregates")))).write.option("maxRecordsPerFile", 1).text(path)
    orgs, edges = readers.read_registry(s, path)
    return orgs.join(edges.groupBy(F.col("parent").alias("slug")).agg(F.count(F.lit(1)).alias("n")), "slug", "left").select("slug", "title", "acronym", F.coalesce("n", F.lit(0)).alias("children"))


def t_payload_ingest(s, d):
    """A base, a batch upon it, and a new base made of both."""
    path = _path(s)
    corpus.fetched(s, d).write.parquet(f"{path}/fetched")
    log = streams.page_log(s, f"{path}/pages")
    stored = corpus.stored(s, d).select("url", "content_hash", F.lit("crawl").alias("source"), F.lit("t0").alias("first_seen"), F.lit("t1").alias("last_seen"), F.lit("t0").alias("last_changed"))
    stored.write.parquet(f"{path}/pages/base/version=-1")
    streams.ingest_payloads(s.readStream.schema(corpus.fetched(s, d).schema).parquet(f"{path}/fetched"), log)
    log.compact(streams.pages_of(log, 0), 0)
    return streams.pages_of(log)


def src_label_sheet(s, d):
    """A sheet with a byte order mark before its first name."""
    path = _path(s)
    writers.write_label_sheet(gold(s, d).withColumnRenamed("url", "\ufeffurl"), path, ["\ufeffurl", "label"])
    return readers.read_label_sheet(s, path).select("url", "label")


def src_payload_json(s, d):
    path = _path(s)
    corpus.payloads(s, d).write.parquet(path)
    return readers.with_validity(s.read.parquet(path)).select("doc_id", F.get_json_object("payload", "$.content_id").alias("content_id"), "valid")


QUERIES = {f.__name__: f for f in (src_label_sheet, src_payload_json, snk_bundle, snk_export_fields, snk_label_sheet, snk_audit_export, src_bundle, src_legacy_import, src_org_registry, t_fetch_health, t_error_share, t_run_totals, t_payload_ingest)} | {"src_legacy_counters": lambda s, d: readers.legacy_counters(*legacy(s, d))}

_BUN = """x AS (SELECT *, doc_id % 25 AS cat, doc_id % 40 + 1 AS run FROM documents), r3 AS (SELECT c_custkey AS run FROM customer WHERE c_custkey % 7 = 3), u AS (SELECT doc_id, lang FROM x WHERE (doc_id % 2 = 0 AND cat = 3) OR (doc_id % 3 = 0 AND cat = 3) OR run IN (FROM r3)),
s AS (SELECT lang AS slug FROM u UNION SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END FROM u), e AS (SELECT * FROM (VALUES ('en', 'sub-en'), ('top', 'even')) v(parent, child) WHERE parent IN (FROM s) OR child IN (FROM s)), o AS (FROM s UNION SELECT parent FROM e UNION SELECT child FROM e)"""

ORACLE_SQL = {
    "snk_export_fields": f"WITH {CONTENT}, {ORGS}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY url) AS n FROM typed WHERE usable) WHERE n = 1), two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY url) AS n FROM typed WHERE usable AND doc_id % 3 = 0) WHERE n = 1) "
    "SELECT 'r1' AS run_id, url, document_type, CAST(strlen(search_text) AS BIGINT) AS size, NULL AS primary_org FROM one UNION ALL SELECT 'r2', two.url, document_type, NULL, organisation_slug FROM two LEFT JOIN po ON po.url = two.url AND role = 'primary'",
    "snk_label_sheet": "SELECT 'https://www.example.org/d/' || doc_id AS url, CASE WHEN toxic = 1 THEN 'borderline' WHEN quality = 1 THEN 'in' ELSE 'out' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'said \"yes\",' || chr(10) || 'then' ELSE '' END AS rationale FROM labels",
    "snk_audit_export": _SEL["a_audit_outcomes"],
    "src_bundle": f"""WITH {_BUN}, slugs AS (SELECT lang AS slug FROM documents UNION SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END FROM documents UNION SELECT unnest(['en', 'sub-en', 'top', 'even', 'far', 'away'])) SELECT * FROM (SELECT 'categories' AS name, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM nation WHERE n_nationkey = 3) AS fresh UNION ALL SELECT 'runs', (SELECT count(*) FROM customer), 0
      UNION ALL SELECT 'results', (SELECT count(*) FROM x), (SELECT count(*) FROM x WHERE run IN (FROM r3)) UNION ALL SELECT 'membership', (SELECT count(*) FROM x WHERE doc_id % 2 = 0 AND CASE WHEN doc_id % 10 = 4 THEN 3 ELSE cat END <> 3) + (SELECT count(*) FROM x WHERE doc_id % 2 = 0 AND cat = 3), 0 UNION ALL SELECT 'counts', 25, 0 UNION ALL SELECT 'audit', (SELECT count(*) FROM x WHERE doc_id % 3 = 0), 0
      UNION ALL SELECT 'pages', (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0 OR doc_id IN (SELECT doc_id FROM u)), (SELECT count(*) FROM u) UNION ALL SELECT 'page_organisations', 2 * (SELECT count(*) FROM documents), 0 UNION ALL SELECT 'hierarchy', 3, 0 UNION ALL SELECT 'organisations', (SELECT count(*) FROM slugs WHERE slug <> 'en' OR 'en' IN (FROM o)), 0)""",
    "src_legacy_import": f"""WITH u AS (SELECT c.doc_id, url, raw FROM ({corpus.ORACLE_SQL['d_canonical_url']}) c JOIN (WITH {corpus._RAW} SELECT doc_id, raw FROM raw) USING (doc_id) WHERE url IS NOT NULL), one AS (SELECT url, arg_min(doc_id, raw) AS k FROM u GROUP BY url), d AS (SELECT one.url, k, CASE WHEN k % 9 <> 0 THEN text ELSE '' END AS content FROM one JOIN documents ON doc_id = k)
      SELECT url, CASE WHEN content <> '' THEN sha256(content) END AS content_hash, CASE WHEN l.doc_id IS NOT NULL THEN 'sitemap' ELSE 'other' END AS source, CASE WHEN k % 8 = 0 THEN 'redirect' ELSE 'guidance' END AS document_type, 't' || k AS title, k % 8 = 0 AS is_redirect, CASE WHEN l.doc_id IS NOT NULL THEN '2026-' || l.doc_id % 12 END AS lastmod
      FROM d LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) l ON url = 'https://www.example.org/d/' || l.doc_id WHERE url NOT IN (SELECT 'https://www.example.org/d/' || doc_id FROM documents WHERE doc_id % 7 = 0)""",
    "src_legacy_counters": f"SELECT count(*) AS content_in, count(url) AS content_written, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) + (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS sitemap_in, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS sitemap_written, count(*) - count(url) + (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS invalid_url FROM ({corpus.ORACLE_SQL['d_canonical_url']})",
    "t_fetch_health": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "t_run_totals": f"WITH {_REP} SELECT run_id, count(*) FILTER (keep = 1) AS kept, count(*) FILTER (keep = 0) AS dropped, count(*) FILTER (keep IS NULL) AS unparsed, round(sum(ms / 1000.0::DOUBLE), 6) AS cost FROM rep GROUP BY run_id",
    "t_error_share": "SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS share FROM events GROUP BY 1",
    "src_org_registry": """WITH e AS (SELECT c_custkey AS p, c_custkey + unnest([1, 2]) AS c FROM customer WHERE c_custkey % 5 = 0 UNION SELECT c_custkey - 1, c_custkey FROM customer WHERE c_custkey % 5 < 3)
SELECT 'c-' || c_custkey AS slug, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey END AS acronym, (SELECT count(*) FROM e WHERE p = c_custkey) AS children FROM customer""",
    "t_payload_ingest": corpus.ORACLE_SQL["d_upsert_provenance"].replace("n.seq % 2 = 0 THEN 'feed'", "n.url IS NOT NULL THEN 'stream'").replace("'t2'", "'0'"),
    "src_label_sheet": f"WITH {GOLD} SELECT url, label FROM gold",
    "src_payload_json": "SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN 'c' || doc_id END AS content_id, doc_id % 13 <> 0 AS valid FROM documents",
    "snk_bundle": f"""WITH {_BUN} SELECT * FROM (SELECT 'categories' AS name, (SELECT count(*) FROM nation WHERE n_nationkey = 3) AS n UNION ALL SELECT 'runs', (SELECT count(*) FROM r3) UNION ALL SELECT 'membership', (SELECT count(*) FROM x WHERE doc_id % 2 = 0 AND cat = 3) UNION ALL SELECT 'counts', 1 UNION ALL SELECT 'audit', (SELECT count(*) FROM x WHERE doc_id % 3 = 0 AND cat = 3)
      UNION ALL SELECT 'results', (SELECT count(*) FROM x WHERE run IN (FROM r3)) UNION ALL SELECT 'pages', (SELECT count(*) FROM u) UNION ALL SELECT 'page_organisations', 2 * (SELECT count(*) FROM u) UNION ALL SELECT 'hierarchy', (SELECT count(*) FROM e) UNION ALL SELECT 'organisations', (SELECT count(*) FROM o))""",
}

"""The driver's tables in the roles of a page corpus, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASOF = "2026-09-15"
TYPES = ("guidance", "news_story", "html_publication", "detailed_guide", "policy_paper")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(*parts: Column) -> Column:
    """32 bits of md5 as a number; DuckDB gives the same."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 5 + 1).cast("int"))
    date = F.concat(F.date_format(F.date_sub(F.to_date(F.lit(ASOF)), (k % 900).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return docs.join(toxic, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("https://www.example.org/d/"), k).alias("url"), F.sha2("text", 256).alias("content_id"), F.substring("text", 1, 60).alias("title"), F.when(k % 11 != 0, F.substring("text", 61, 40)).alias("description"), F.col("text").alias("search_text"),
        kind.alias("document_type"), F.when(k % 3 == 0, "guidance").otherwise("").alias("parent_document_type"), (k % 17 == 0).alias("is_redirect"),
        F.when(k % 13 != 0, F.sha2("text", 256)).alias("content_hash"), (F.coalesce("toxic", F.lit(0)) == 1).alias("withdrawn"),
        F.when(k % 7 == 0, "").otherwise(date).alias("public_updated_at"), "lang", "source", F.when(k % 4 != 0, date).alias("first_published_at"), date.alias("last_seen_at"),
        F.when(k % 3 == 0, k * 2).alias("view_count"), F.when(k % 3 == 0, F.when(k % 2 == 0, "page").otherwise("parent")).alias("view_count_source"), F.when(k % 3 == 0, F.lit(ASOF)).alias("view_count_updated"), F.concat(F.lit('{"id":'), k, F.lit("}")).alias("content"),
    )


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to organisations: the language, and a second by parity."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://www.example.org/d/"), F.col("doc_id")).alias("url")
    own = docs.select(url, F.col("lang").alias("organisation_slug"), F.lit("primary").alias("role"))
    return own.union(docs.select(url, F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"), F.lit("related")))


def verdicts(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """A run's verdict, score and duration of each labelled document, by hash."""
    k = F.col("doc_id").cast("string")
    h = lambda salt: hashed(k, F.lit(f":{run}:{salt}"))
    keep = F.when(h("k") % 10 < 6, 1).when(h("k") % 10 < 9, 0)
    return table(spark, sf_dir, "labels").select(F.lit(run).alias("run_id"), F.concat(F.lit("https://www.example.org/d/"), k).alias("url"), keep.alias("keep"), (h("s") % 1000 / 1000.0).alias("score"), (h("m") % 5000).alias("ms"), "doc_id")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "borderline").when(F.col("quality") == 1, "in").otherwise("out")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("https://www.example.org/d/"), F.col("doc_id")).alias("url"), label.alias("label"), "doc_id")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labellers, with a second round that changes some votes and withdraws some."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("labeller")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("labelled_at"))
    h = hashed(F.col("doc_id").cast("string"), F.lit(":"), F.col("labeller"), F.lit(":"), F.col("labelled_at").cast("string"))
    label = F.when(h % 10 < 5, "in").when(h % 10 < 8, "out").when(h % 10 < 9, "borderline")
    return rows.where((F.col("labelled_at") == 1) | (h % 3 == 0)).select(F.concat(F.lit("https://www.example.org/d/"), F.col("doc_id")).alias("url"), "labeller", "labelled_at", label.alias("label"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as paid calls."""
    e = table(spark, sf_dir, "events")
    model = F.when(F.col("user_id") % 2 == 0, "small").otherwise("large")
    return e.select("event_id", "ts", model.alias("model"), F.col("event_type").alias("phase"), (F.col("event_id") % 1000).alias("miss"), (F.col("event_id") % 300).alias("hit"), (F.col("event_id") % 70).alias("out"), "value")


CONTENT = """labelled AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
content AS (SELECT d.doc_id, 'https://www.example.org/d/' || d.doc_id AS url, sha256(text) AS content_id, substr(text, 1, 60) AS title, CASE WHEN d.doc_id % 11 <> 0 THEN substr(text, 61, 40) END AS description, text AS search_text, source,
  ['guidance', 'news_story', 'html_publication', 'detailed_guide', 'policy_paper'][d.doc_id % 5 + 1] AS document_type,
  CASE WHEN d.doc_id % 3 = 0 THEN 'guidance' ELSE '' END AS parent_document_type, d.doc_id % 17 = 0 AS is_redirect,
  CASE WHEN d.doc_id % 13 <> 0 THEN sha256(text) END AS content_hash, coalesce(toxic, 0) = 1 AS withdrawn,
  CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2026-09-15' - CAST(d.doc_id % 900 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' END AS public_updated_at, lang
  FROM documents d LEFT JOIN labelled l ON l.doc_id = d.doc_id),
typed AS (SELECT *, CASE WHEN document_type = 'html_publication' AND parent_document_type <> '' THEN parent_document_type ELSE document_type END AS eff,
  lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(search_text, '')) AS kwt, coalesce(content_id, url) AS key, NOT is_redirect AND content_hash IS NOT NULL AND NOT withdrawn AS usable FROM content)"""
ORGS = """po AS (SELECT 'https://www.example.org/d/' || doc_id AS url, lang AS organisation_slug, 'primary' AS role FROM documents
  UNION ALL SELECT 'https://www.example.org/d/' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END, 'related' FROM documents)"""


def verdict_sql(name: str, run: str) -> str:
    h = lambda salt: f"(('0x' || substr(md5(doc_id || ':{run}:{salt}'), 1, 8))::BIGINT)"
    return f"""{name} AS (SELECT '{run}' AS run_id, 'https://www.example.org/d/' || doc_id AS url, CASE WHEN {h("k")} % 10 < 6 THEN 1 WHEN {h("k")} % 10 < 9 THEN 0 END AS keep,
  ({h("s")} % 1000) / 1000.0::DOUBLE AS score, {h("m")} % 5000 AS ms, doc_id FROM labels)"""


GOLD = "gold AS (SELECT 'https://www.example.org/d/' || doc_id AS url, CASE WHEN toxic = 1 THEN 'borderline' WHEN quality = 1 THEN 'in' ELSE 'out' END AS label, doc_id FROM labels)"
VOTES = """raw AS (SELECT *, ('0x' || substr(md5(doc_id || ':' || labeller || ':' || labelled_at), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(['a', 'b', 'c']) AS labeller FROM labels), (SELECT unnest([1, 2]) AS labelled_at)),
votes AS (SELECT 'https://www.example.org/d/' || doc_id AS url, labeller, labelled_at, CASE WHEN h % 10 < 5 THEN 'in' WHEN h % 10 < 8 THEN 'out' WHEN h % 10 < 9 THEN 'borderline' END AS label
  FROM raw WHERE labelled_at = 1 OR h % 3 = 0),
latest AS (SELECT url, labeller, label FROM (SELECT *, row_number() OVER (PARTITION BY url, labeller ORDER BY labelled_at DESC) AS n FROM votes) WHERE n = 1 AND label IS NOT NULL)"""
LEDGER = """ledger AS (SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, event_type AS phase, event_id % 1000 AS miss, event_id % 300 AS hit, event_id % 70 AS out, value FROM events)"""

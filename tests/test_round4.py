"""What the third round's findings were about: exact sketches, cut-off references, repeated rows of an import."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions import english
from corpusloom.functions.html import html_text
from corpusloom.operators import hierarchy, phrases, sketches
from corpusloom.sources import readers


def test_sketches_in_parts_are_exact(spark):
    """60,000 pages with an alias each, of which a third have both organisations."""
    k = F.col("id")
    pages = spark.range(120_000).select(F.concat(F.lit("u"), k).alias("url"), F.concat(F.lit("k"), (k / 2).cast("long")).alias("content_id"), F.lit("guidance").alias("document_type"), F.lit("").alias("parent_document_type"), F.lit(False).alias("is_redirect"), F.lit("h").alias("content_hash"), F.lit(False).alias("withdrawn"))
    links = spark.range(80_000).select(F.concat(F.lit("u"), k).alias("url"), F.lit("a").alias("organisation_slug")).union(spark.range(40_000, 120_000).select(F.concat(F.lit("u"), k), F.lit("b")))
    parts = sketches.parts_for(120_000)
    made = sketches.page_sketches(pages, links, parts=parts)
    assert parts == 15 and sketches.parts_for(0) == sketches.parts_for(8192) == 1
    assert [sketches.approximate_count(made, *a).first().n for a in ([], [["a"]], [["b"], ["guidance"]], [["c"]])] == [60_000, 40_000, 40_000, 0]
    assert [tuple(r) for r in sketches.approximate_overlaps(made).collect()] == [("a", "b", 20_000)]


def test_names_without_a_semicolon(spark):
    df = spark.createDataFrame([("x &amp y &copy; &ampz &amp;",)], "t string")
    assert df.select(html_text(df.t), html_text(df.t, bare_names=False)).first()[:] == ("x & y © &z &", "x &amp y © &ampz &")


def test_legacy_rows_of_one_spelling(spark):
    """The first row by order stays, wherever it lies; without an order the least by what it holds."""
    rows = [("https://example.org/", f"text {n}", "guidance", f"t{n}", n) for n in (107, 9, 27, 7, 1007)] + [("https://example.org/a", None, None, None, 3)] * 2
    pages = spark.createDataFrame(rows, "url string, content string, document_type string, title string, n int").repartition(5)
    none = spark.createDataFrame([], "url string, lastmod string")
    got = lambda **k: {(r.url, r.title, r.content) for r in readers.legacy_rows(pages, none, none, **k).collect()}
    assert got(order="n") == {("https://www.example.org/", "t7", "text 7"), ("https://www.example.org/a", None, None)}
    assert got() == {("https://www.example.org/", "t1007", "text 1007"), ("https://www.example.org/a", None, None)}


def test_expand_broadcasts_nothing(spark, monkeypatch):
    """Levels would broadcast the edges or what was found again and again; results with a cycle."""
    plans = []

    def cut(df, real=hierarchy.cut):
        done = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return done

    monkeypatch.setattr(hierarchy, "cut", cut)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("r", "a"), ("q", "x"), ("q", "y")], "root string, slug string")
    assert {tuple(r) for r in hierarchy.expand(edges, seeds).collect()} == {("r", "b"), ("r", "c"), ("r", "d"), ("q", "y")}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)


def test_grounding_of_short_texts(spark, tmp_path):
    """Texts of one and two letters have no third to quote from; the SQL's counts on the same rows."""
    texts = ["A.", "b", "Re.", "La é le de de.", "The third of three, and more."]
    spark.createDataFrame([(k, texts[k % 5]) for k in range(600)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(600).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r) for r in entry.queries()["m_grounding"](spark, str(tmp_path)).select("check", "n", "passed", "share").collect()}
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = c.execute(entry.oracle_sql()["m_grounding"])
    at = [[x[0] for x in found.description].index(name) for name in ("check", "n", "passed", "share")]
    assert got == {tuple(r[i] for i in at) for r in found.fetchall()}


def test_posting_lists(spark):
    """A page's lists as arrays are those of its units one by one; plain words need no longer form to be tried."""
    rng = random.Random(2)
    words = ["food", "Foods.", "the", "of", "foo-bar", "the-a-farm", "www.example.org/a-b/c", "a@b.example.com", "1.2.3", "x_y", "éa", "runs!", "a.b+c@x-y.example.com", "e.g.", "50%", "-"]
    texts = ["", "the", None] + [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "url int, text string").select(F.col("url").cast("string"), phrases.whole_units(F.col("text")).alias("units"))
    want = {}
    for url, text in enumerate(texts):
        for at, word in enumerate(english.units(text)):
            if word not in english.STOP:
                want.setdefault((english.stem(word), str(url)), []).append(at)
    rows = df.mapInArrow(phrases.posting_lists, "stem string, url string, positions array<int>").collect()
    assert len(rows) == len(want) and {(r.stem, r.url): r.positions for r in rows} == want
    none = pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))], ["url", "units"])
    assert [b.num_rows for b in phrases.posting_lists(iter([none]))] == [0]

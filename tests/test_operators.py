"""Small tables with known results."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.bands import freshness_band
from corpusloom.functions.readability import syllables
from corpusloom.functions.urls import canonical_url
from corpusloom.operators import compare, filters, gold, hierarchy, ingest, metrics, reports, runs
from corpusloom.sources import readers


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("/a", "guidance", False, "h", "slurry storage rules"), ("/b", "guidance", False, "h", "nitrate vulnerable zones"), ("/c", "news_story", False, "h", "slurry spreading news"),
        ("/d", "guidance", True, "h", "old slurry page"), ("/e", "guidance", False, None, "slurry missing"),
    ]
    df = spark.createDataFrame(rows, "url string, document_type string, is_redirect boolean, content_hash string, search_text string")
    return df.withColumns({"title": F.lit(""), "description": F.lit(None).cast("string"), "content_id": F.lit(None).cast("string"), "parent_document_type": F.lit(""), "withdrawn": F.lit(False)})


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("/a", "agency"), ("/b", "agency"), ("/c", "department"), ("/d", "agency"), ("/e", "agency")], "url string, organisation_slug string")


def urls(df):
    return sorted(r.url for r in df.collect())


def test_shortlist(pages, links):
    assert urls(filters.shortlist(pages, links, words=["slurry"])) == ["/a", "/c"]
    assert urls(filters.shortlist(pages, links, ["agency"], ["guidance"])) == ["/a", "/b"]
    assert urls(filters.shortlist(pages, links, words=["slurry", "nitrate"], match="all")) == []
    assert urls(filters.shortlist(pages, links, words=["slurry", "nitrate"])) == ["/a", "/b", "/c"]
    assert urls(filters.shortlist(pages, links, words=["slurry"], redirects=True, unfetched=True)) == ["/a", "/c", "/d", "/e"]


def test_funnel_narrows(pages, links):
    row = filters.funnel(pages, links, ["agency"], ["guidance"], ["slurry"]).first()
    assert tuple(row) == (3, 2, 2, 1)


def test_audit(pages, links):
    found = {r.url: r.outcome for r in reports.audit(pages.where(filters.is_usable()), links, ["agency"], ["guidance"], ["slurry"]).collect()}
    assert found == {"/a": "included", "/b": "dropped: keyword"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://example.org/foo/bar/", "https://www.example.org/foo/bar"), ("https://example.org/", "https://www.example.org/"), ("https://example.org", "https://www.example.org/"), ("https://www.example.org/foo?x=1#section", "https://www.example.org/foo"),
        ("http://www.example.org/foo", "https://www.example.org/foo"), ("  https://example.org/foo  ", "https://www.example.org/foo"), ("https://example.orghttps://web…", None), ("https://example.com/foo", None), ("ftp://example.org/", None), ("/path", None), ("", None), (None, None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def test_syllables_and_bands(spark):
    df = spark.createDataFrame([("made", "2026-09-10"), ("the", "2025-05-05"), ("happy", "")], "w string, d string")
    assert [tuple(r) for r in df.select(syllables(F.col("w")), freshness_band(F.col("d"), "2026-09-15")).collect()] == [(1, "< 1 month"), (1, "1-2 years"), (2, "Unknown")]


def test_hierarchy(spark):
    edges = spark.createDataFrame([("m", "s"), ("s", "t"), ("t", "m"), ("m", "e")], "parent string, child string")
    assert sorted(r.slug for r in hierarchy.descendants(edges, "m").collect()) == ["e", "m", "s", "t"]
    tree = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "parent string, child string")
    counts = spark.createDataFrame([("a", 1), ("b", 5)], "slug string, pages long")
    assert sorted(tuple(r)[:3] for r in hierarchy.forest(tree, counts).collect() if r.parent) == [("c", "b", 1), ("d", "c", 2)]


def test_redirects(spark):
    rows = [("a", 200, True, "b"), ("b", 200, True, "c"), ("c", 200, False, None), ("x", 200, True, "y"), ("y", 200, True, "x"), ("p", 200, True, "q"), ("g", 200, True, "h"), ("h", 410, False, None), ("e", 503, False, None), ("o", 200, True, None), *[(f"n{k}", 200, True, f"n{k + 1}") for k in range(8)]]
    fetched = spark.createDataFrame(rows, "url string, http_status int, is_redirect boolean, destination string")
    found = {r.src: r for r in ingest.redirect_chains(fetched, fetched.select("url"), 5).collect()}
    assert len(found) == len(rows) and tuple(found["a"])[1:] == ("c", 200, ["a", "b", "c"], None) and tuple(found["c"])[1:] == ("c", 200, ["c"], None)
    assert tuple(found["x"])[1:] == (None, None, ["x", "y"], "circular") and tuple(found["p"])[1:] == ("q", 404, ["p", "q"], "not_found")
    assert tuple(found["g"])[1:4:2] == ("h", ["g", "h"]) and found["g"].error == "gone" and found["e"].error == "http_503" and found["o"].error == "external"
    assert found["n0"].error == "max_depth" and len(found["n0"].hops) == 6 and found["n4"].error == "not_found"
    assert ingest.redirect_chains(fetched, fetched.select("url").limit(0)).count() == 0


def test_gold_and_metrics(spark):
    votes = spark.createDataFrame([("u1", "a", "in"), ("u2", "a", "in"), ("u2", "b", "in"), ("u3", "a", "in"), ("u3", "b", "out"), ("u4", "a", "in"), ("u4", "b", "out"), ("u4", "c", "in")], "url string, labeller string, label string")
    found = {r.url: (r.label, r.agreement) for r in gold.consensus(votes.withColumn("rationale", F.lit("r"))).collect()}
    assert found == {"u1": ("in", "single"), "u2": ("in", "unanimous"), "u3": ("borderline", "split"), "u4": ("in", "majority")}
    labels = spark.createDataFrame([("a", "in"), ("b", "in"), ("c", "out"), ("d", "out"), ("e", "borderline"), ("f", "in")], "url string, label string")
    verdicts = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 0), ("e", 1), ("f", None)], "url string, keep int")
    got = {r.bound: r for r in metrics.rates(metrics.confusion(labels, verdicts)).collect()}
    r = got["exclude"]
    assert (r.tp, r.fp, r.fn, r.tn, r.n, r.unparsed) == (1, 1, 2, 1, 5, 1)
    assert (r.precision, r.recall, r.specificity) == (0.5, pytest.approx(1 / 3), 0.5)
    assert got["in"].tp == 2 and got["out"].fp == 2


@pytest.mark.parametrize("a, b, p", [(0, 0, None), (5, 0, 0.0625), (3, 3, 1.0), (8, 1, 0.0390625)])
def test_mcnemar(spark, a, b, p):
    names = [f"x{k}" for k in range(a)] + [f"y{k}" for k in range(b)] + ["z"]
    labels = spark.createDataFrame([(n, "in") for n in names], "url string, label string")
    first = spark.createDataFrame([(n, int(n[0] != "y")) for n in names], "url string, keep int")
    second = spark.createDataFrame([(n, int(n[0] != "x")) for n in names], "url string, keep int")
    row = metrics.mcnemar(labels, first, second).first()
    assert (row.only_a, row.only_b) == (a, b) and row.p == (p if p is None else pytest.approx(p))


def test_search_floor(spark):
    rows = spark.createDataFrame([("a", "a", "shortlister", None), ("b", "b", "both", 0.004), ("c", "c", "search", 0.005)], "key string, url string, source string, es_score double")
    assert urls(compare.augmented(rows, rows.select("url"), 0.01)) == ["a", "b"]


def test_runs(spark):
    base = spark.createDataFrame([("p0", 1, 0.9), ("p1", 1, 0.7), ("p2", 0, 0.1), ("p3", None, None), ("p4", 1, 0.8)], "url string, keep int, score double")
    other = spark.createDataFrame([("p0", 1, 0.9), ("p1", 0, 0.2), ("p2", 1, 0.6), ("p3", 1, 0.5)], "url string, keep int, score double")
    row = runs.phase_compare(base, other).first()
    assert (row.shared, row.only_base, row.accepted_rejected, row.rejected_accepted, row.with_unscored) == (4, 1, 1, 1, 1)
    assert runs.disagreements(base, other).count() == 3


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x/a</loc><lastmod>2026-01-01</lastmod></url><url><loc> https://x/b </loc></url></urlset>')
    assert sorted((r.loc, r.lastmod) for r in readers.read_sitemap(spark, str(tmp_path / "s.xml")).collect()) == [("https://x/a", "2026-01-01"), ("https://x/b", None)]


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"aggregates": {"organisations": {"options": [{"value": {"slug": "m", "title": "M", "child_organisations": ["s"]}}, {"value": {"link": "/o/s/", "title": "S", "parent_organisations": ["m"]}}]}}}')
    orgs, edges = readers.read_registry(spark, str(tmp_path / "r.json"))
    assert sorted(r.slug for r in orgs.collect()) == ["m", "s"] and [tuple(r) for r in edges.collect()] == [("m", "s")]


def test_change_classes(spark):
    fetched = spark.createDataFrame([(0, "bad", 200, "x"), (1, "https://example.org/a", 200, "x"), (2, "https://example.org/a/", 200, "x"), (3, "https://example.org/b", 404, None), (4, "https://example.org/c", 500, None)], "seq int, raw_url string, http_status int, body string")
    stored = spark.createDataFrame([("https://www.example.org/zz", "h")], "url string, content_hash string")
    assert [r.change for r in ingest.change_classes(fetched, stored).orderBy("seq").collect()] == ["invalid", "new", "duplicate", "no_content_item", "error"]

"""Nulls, empty tables and limits of saved selections and payloads."""

import pytest

from corpusloom.operators import payload, review, workspace

LISTS = "id long, name string, orgs string, types string, words string"
PAGE = "url string, content_id string, title string, description string, search_text string, document_type string, parent_document_type string, is_redirect boolean, content_hash string, withdrawn boolean"


def pages(spark):
    return spark.createDataFrame([("/a", None, "Slurry", None, None, "guidance", "", False, "h", None), ("/b", "x", None, None, "other", "news_story", None, None, "h", False), ("/c", "x", "slurry", None, "", "guidance", "", True, "h", False)], PAGE)


def links(spark):
    return spark.createDataFrame([("/a", "en"), ("/b", None)], "url string, organisation_slug string")


def test_refresh(spark):
    specs = spark.createDataFrame([(1, "all", None, "", " , "), (2, "one", "en, en", "guidance", "SLURRY"), (3, "none", "fr", None, None)], LISTS)
    got = {(r.category_id, r.content_id, r.url) for r in workspace.refresh(pages(spark), links(spark), specs).collect()}
    assert got == {(1, "/a", "/a"), (1, "x", "/b"), (2, "/a", "/a")}
    assert workspace.refresh(pages(spark), links(spark), specs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        workspace.refresh(pages(spark), links(spark), specs, most=2)


def test_validate(spark):
    specs = spark.createDataFrame([(1, None, None, None, None), (2, "ok", "en", "", ""), (3, "a/b", "", "x", "")], LISTS)
    assert {tuple(r) for r in workspace.validate(specs, 10).collect()} == {(1, "name is required"), (1, "no filter"), (3, "name has other characters")}


def test_payload_without_content(spark):
    rows = spark.createDataFrame([("https://www.example.org/a", p) for p in (None, "", "{bad", "{}")], "url string, payload string")
    assert payload.child_links(rows).count() == 0
    assert {r[0] for r in rows.select(payload.body_text(rows["payload"])).collect()} == {""}


def test_end_to_end(spark):
    kind = "url string, keep int, score double"
    first = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.9), ("c", 0, 0.1), ("d", None, None), ("e", 1, 0.5)], kind)
    second = spark.createDataFrame([("a", 0, 0.2), ("e", None, None)], kind)
    assert {tuple(r) for r in review.end_to_end(first, second).collect()} == {("a", 0), ("b", 1), ("c", 0), ("d", None), ("e", None)}

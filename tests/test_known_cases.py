"""Cases with results that are known from outside: texts, payloads, tokens, findings, forests, comparisons."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import readability
from corpusloom.functions.bands import freshness_band, reading_band
from corpusloom.functions.html import html_text
from corpusloom.operators import compare, cost, export, gold, hierarchy, ingest, payload, reports


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<p>Store <b>slurry</b> &amp; silage</p><script>var x=1</script>", "Store slurry & silage"), ("<li>one</li><li>two</li>", "one two"), ("", ""), (None, ""),
        ("caf&#233; caf&eacute; &lt;b&gt;x&lt;/b&gt;", "café café x"), ("a<br>b<br/>c", "ab c"), ("x&nbsp; \n y<!-- no -->z", "x yz"), ('<a title="a>b">t</a> 1 < 2', "t 1 < 2"), ("<style>p{}</style><h2>H</h2>t", "H t"),
    ],
)
def test_html_text(spark, raw, want):
    assert one(spark, raw, html_text) == want


def test_body_text(spark):
    cases = {'{"details": {"body": "<p>nitrate vulnerable zones</p>"}}': "nitrate vulnerable zones", '{"details": {"parts": [{"slug": "a", "body": "<p>part one</p>"}, {"slug": "b", "body": "<p>part two</p>"}]}}': "part one part two", '{"details": {}}': "", "{bad": "", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    assert all(r.got == r.want for r in df.select("want", payload.body_text(F.col("x")).alias("got")).collect())


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"public_updated_at": "2026-07-08T15:30:54+01:00", "updated_at": "2026-08-01T00:00:00+01:00"}', "2026-07-08T15:30:54+01:00"), ('{"updated_at": "2026-08-01"}', "2026-08-01"),
        ('{"first_published_at": "2020", "public_timestamp": "2021", "updated_at": "2022", "public_updated_at": ""}', "2021"), ('{"title": "x"}', ""), ("{bad json", ""), ("", ""),
    ],
)
def test_payload_date(spark, raw, want):
    assert one(spark, raw, ingest.payload_date) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Guidance from the agency and its office about forms step-by-step", None), ("", None), (None, None), ("owner is jane.doe@dept.example.org please", ("personal_data", "an email address (j•••@d•••)")),
        ("call me on 07123 456789", ("personal_data", "a phone number (•••89)")), ("+44 7123 456 789.", ("personal_data", "a phone number (•••89)")), ("ref x07123456789", None), ("this is Shit guidance", ("prohibited_language", "language that is not permitted")),
        ("Guidance on the assassination inquiry and shitake mushrooms", None), ("mention of a Widget.", ("prohibited_language", "language that is not permitted")), ("widgets", None),
    ],
)
def test_guardrail(spark, raw, want):
    found = one(spark, raw, lambda c: ingest.guardrail(c, ["widget"]))
    assert (found and tuple(found)) == want


def test_reading_age(spark):
    simple = "The cat sat on the mat. The dog ran to the park. We had a good day. It was fun to play outside. Birds can fly."
    hard = "The aforementioned methodology necessitates comprehensive reconceptualisation of institutional frameworks, notwithstanding considerable epistemological uncertainties regarding the underlying theoretical presuppositions herein."
    age = lambda t: one(spark, t, lambda c: readability.reading_age(readability.grade(c)))
    assert age("Too short.") is None and age(None) is None and 5.0 <= age(simple) < age(hard)
    assert age("The cat sat on the mat and had fun today.") >= 5.0
    assert one(spark, "one two three four five. six seven eight nine ten eleven twelve", readability.sentence_count) == 1
    assert one(spark, "a?! b... c", readability.sentence_count) == 2 and one(spark, "", readability.sentence_count) == 1
    assert [one(spark, x, reading_band, "double") for x in (None, 8.9, 9.0, 11.9, 12.0, 15.0, 18.0)] == ["Unknown", "Under 9", "9-11", "9-11", "12-14", "15-17", "18+"]
    assert one(spark, "2026-01-01", lambda c: freshness_band(c, "2026-09-15")) == "3 months-1 year"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"prompt_tokens": 1050, "completion_tokens": 200, "prompt_cache_hit_tokens": 300, "prompt_cache_miss_tokens": 750}', (1050, 300, 750, 200)), ('{"input_tokens": 800, "output_tokens": 200, "cache_read_input_tokens": 200}', (1000, 200, 800, 200)),
        ('{"input_tokens": 800, "output_tokens": 200, "cache_read_input_tokens": 200, "cache_creation_input_tokens": 50}', (1050, 200, 850, 200)), ('{"prompt_tokens": 100, "completion_tokens": 5, "prompt_cache_hit_tokens": 300}', (100, 300, 0, 5)),
        ('{"input_tokens": 800}', (None,) * 4), ("{bad", (None,) * 4), (None, (None,) * 4),
    ],
)
def test_usage(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(*cost.usage(F.col("x"))).first()) == want


def test_footprint(spark):
    rows = spark.createDataFrame([(1_000_000, 200_000, 800_000, 100_000), (500_000, None, None, 0)], "total long, hit long, miss long, out long")
    got = {(r.measure, r.level): r.amount for r in cost.footprint(rows).collect()}
    joules = 800_000 * 0.3 + 200_000 * 0.3 * 0.25 + 100_000 * 1.5
    assert got["kwh", "point"] == pytest.approx(joules * 1.2 / 3.6e6) and got["co2_kg", "point"] == pytest.approx(0.2 * got["kwh", "point"])
    assert got["kwh", "high"] == pytest.approx((800_000 + 200_000 * 0.5 + 100_000 * 5) * 1.5 * 1.3 / 3.6e6)
    bare = {(r.measure, r.level): r.amount for r in cost.footprint(rows.where("hit IS NULL")).collect()}
    assert bare["kwh", "point"] == pytest.approx(500_000 * 0.3 * 1.2 / 3.6e6)
    assert all(r.amount == 0 for r in cost.footprint(rows.limit(0)).collect())
    assert {r.label: r.amount for r in cost.equivalents(cost.footprint(rows)).collect()}["phone charges"] == pytest.approx(got["kwh", "point"] * 100)


def test_forest(spark):
    edges = spark.createDataFrame([("justice", "courts"), ("courts", "tribunal"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("small", "tribunal")], "parent string, child string")
    counts = spark.createDataFrame([("justice", 4), ("tribunal", 2), ("courts", 1)], "slug string, pages long")
    got = {r.slug: (r.parent, r.depth, r.pages) for r in hierarchy.forest(edges, counts).collect()}
    assert got["tribunal"] == ("courts", 2, 2) and got["justice"] == (None, 0, 4) and got["small"] == (None, 0, 0) and got["x"] == (None, 0, 0)
    assert [got[k][:2] for k in "abcde"] == [(None, 0)] * 3 + [("c", 1), ("d", 2)]
    assert hierarchy.forest(edges.limit(0), counts).count() == 0


def test_compare_takes_the_first_hit(spark):
    short = spark.createDataFrame([("k1", "/a", "A", "guide", ["x"]), ("k2", "/b", "B", "guide", [])], "key string, url string, title string, document_type string, matched array<string>")
    hits = spark.createDataFrame([("k1", "/a2", "first", "t", ["p"], 0.1, 3), ("k1", "/a", "later", "t", ["q"], 0.9, 5), ("k3", "/c", "C", None, ["p", "q"], 0.4, 1)], "key string, url string, title string, document_type string, phrases array<string>, es_score double, first_hit int")
    got = {r.key: r for r in compare.compare(short, hits).collect()}
    assert (got["k1"].url, got["k1"].title, got["k1"].source, got["k1"].phrases, got["k1"].matched, got["k1"].es_score) == ("/a", "A", "both", ["p"], ["x"], 0.1)
    assert (got["k2"].source, got["k2"].phrases, got["k3"].source, got["k3"].url, got["k3"].matched) == ("shortlister", None, "search", "/c", None)
    rows = compare.compare(short, hits)
    held = spark.createDataFrame([("/c",)], "url string")
    assert tuple(compare.evaluable(rows, held).first()) == (3, 1, 0)
    assert [r.url for r in compare.augmented(rows, held, 0.0, loaded=True).collect()] == ["/c"] and compare.augmented(rows, held, 0.0, title="b").count() == 1


def test_containers_pass_on_their_phrases(spark):
    rows = spark.createDataFrame([("k0", "/box", "search", ["p"], 0.5), ("k1", "/a", "shortlister", None, None), ("k9", "/box2", "search", ["q"], 0.4)], "key string, url string, source string, phrases array<string>, es_score double")
    attachments = spark.createDataFrame([("/box", "/a"), ("/box", "/n"), ("/box2", "/gone")], "container string, attachment string")
    corpus = spark.createDataFrame([("/a", "k1"), ("/n", "k5")], "url string, key string")
    got = {r.url: (r.source, r.phrases, r.es_score) for r in compare.resolve_containers(rows, attachments, corpus).collect()}
    assert got == {"/a": ("both", ["p"], 0.5), "/n": ("search", ["p"], 0.5), "/box2": ("search", ["q"], 0.4)}


def test_export_fields(spark):
    cols = "url string, content_id string, title string, document_type string, parent_document_type string, search_text string, public_updated_at string"
    pages = spark.createDataFrame([("/b", "1", "B", "html_publication", "guidance", "é", ""), ("/a", "1", "A", "guidance", None, "xx", "2026-09-14"), ("/c", None, "C", "guidance", None, None, None)], cols)
    links = spark.createDataFrame([("/a", "o2", "related"), ("/a", "o1", "primary"), ("/a", "o1", "related")], "url string, organisation_slug string, role string")
    out = export.export(pages, links, ["size", "url", "nonsense", "organisations", "primary_org", "last_update_band"], "2026-09-15")
    assert out.columns == ["url", "size", "organisations", "primary_org", "last_update_band"]
    assert [tuple(r) for r in out.collect()] == [("/a", 2, "o1, o2", "o1", "< 1 month"), ("/c", None, None, None, "Unknown")]
    assert len(export.fields("2026-09-15")) == 22
    assert export.stacked({"r1": out, "r2": out.select("url")}).count() == 4
    assert export.export(pages.limit(0), links, ["title"], "2026-09-15").count() == 0


def test_order_does_not_depend_on_parts(spark):
    import hashlib

    rows = spark.range(900).select(F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 3 == 0, "b").alias("stage"))
    got = {r.url: r.position for r in gold.stratified_order(rows, ["stage"], "s").collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.stage, []).append(r.url)
    queue = sorted(((len(v), k is not None, k or ""), sorted(v, key=lambda u: hashlib.sha1(f"s:{u}".encode()).hexdigest())) for k, v in by.items())
    want, turn = {}, 0
    while len(want) < 900:
        for _, urls in queue:
            if turn < len(urls):
                want[urls[turn]] = len(want) + 1
        turn += 1
    assert got == want
    assert gold.stratified_order(rows.limit(0), ["stage"], "s").count() == 0


def test_sheet_errors(spark):
    sheet = spark.createDataFrame([(1, "/a", "in", "r"), (2, "/a", "in", "r"), (3, None, "maybe", ""), (4, "/x", "out", "r"), (5, "/c", "out", "r"), (6, " ", "in", "r")], "line int, url string, label string, rationale string")
    sent, corpus = spark.createDataFrame([("/a",)], "url string"), spark.createDataFrame([("/a",), ("/c",)], "url string")
    got = {(r.line, r.error) for r in gold.sheet_errors(sheet, sent, corpus).collect()}
    assert got == {(2, "duplicate url"), (3, "empty url"), (3, "bad label"), (3, "missing rationale"), (4, "not in corpus"), (5, "not forwarded"), (6, "empty url")}
    labels = spark.createDataFrame([("/a", "out")], "url string, label string")
    assert [r.note for r in gold.sheet_drift(sheet.where("line = 1"), "x", labels, "y").collect()] == ["out -> in"] and gold.sheet_drift(sheet, "x", labels, "x").count() == 0


def test_stage_means(spark):
    pages = spark.createDataFrame([("aa", "", 9.0, 2, 5), ("b", None, None, 4, None)], "search_text string, public_updated_at string, reading_age double, english_score int, english_stars int")
    row = reports.stage_stats(pages, "2026-09-15").first()
    assert (row.n, row.mean_size, row.mean_age, row.mean_issues, row.mean_stars, row.unknown) == (2, 1.5, 9.0, 3.0, 5.0, 2)


def test_payload_parts(spark):
    raw = (
        '{"base_path": "/g/", "details": {"body": [{"content_type": "text/govspeak", "content": "<a href=\\"/no\\">n</a>"}, {"content_type": "text/html", "content": "<p><a class=x href=\\"/a\\">one <b>A</b></a><A HREF=\\"/a\\">again</A><a href=\\"#top\\">t</a></p>"}],'
        ' "parts": [{"slug": "p1", "body": "<a href=\\"MAILTO:x@y\\">m</a><a href=\\"https://other.example/b\\"> </a>"}], "attachments": [{"attachment_type": "html", "url": "/h/", "body": "<a href=\\"https://example.org/c\\">c</a>"}, {"attachment_type": "file", "url": "/f.pdf"}]},'
        ' "links": {"children": [{"base_path": "/g"}, {"base_path": "/k"}], "primary_publishing_organisation": [{"content_id": "1", "base_path": "/government/organisations/courts/tribunal/"}], "organisations": [{"content_id": "1", "base_path": "/x/first"}, {"content_id": "1", "base_path": "/x/second"}, {"content_id": "2"}]}}'
    )
    pages = spark.createDataFrame([("https://www.example.org/g", raw), ("https://www.example.org/bad", "{"), ("https://www.example.org/none", None)], "url string, payload string")
    links = {r.url[-3:]: [tuple(x) for x in r.l] for r in pages.select("url", ingest.body_links(payload.blobs(F.col("payload"))).alias("l")).collect()}
    assert links == {"g/g": [("https://www.example.org/a", "one A", False), ("https://other.example/b", "https://other.example/b", True), ("https://example.org/c", "c", False)], "bad": [], "one": []}
    assert sorted(map(tuple, payload.child_links(pages).select("child", "relation").collect())) == [("https://www.example.org/g/p1", "part"), ("https://www.example.org/h", "attachment"), ("https://www.example.org/k", "child")]
    assert [r.n for r in pages.select(payload.file_count(F.col("payload")).alias("n")).collect()] == [1, 0, 0]
    assert [tuple(r)[1:] for r in payload.page_organisations(pages).collect()] == [("1", "tribunal", "primary"), ("1", "first", "related"), ("2", "", "related")]
    assert tuple(payload.organisation_counters(pages).first()) == (2, 1, 3, 1)


def test_view_counts(spark):
    pages = spark.createDataFrame([("https://h/a/b/c", None, None, None), ("https://h/a/b", 1, "page", "old"), ("https://h/x", 9, "page", "today"), ("https://h/q/r", None, None, None)], "url string, view_count long, view_count_source string, view_count_updated string")
    counts = spark.createDataFrame([("/a/b", 5), ("/x", 4), ("/q", 3)], "path string, views long")
    got = {r.url: tuple(r)[1:] for r in ingest.view_counts(pages, counts, "today").collect()}
    assert got == {"https://h/a/b/c": (5, "parent", "today"), "https://h/a/b": (5, "page", "today"), "https://h/x": (9, "page", "today"), "https://h/q/r": (None, None, None)}


def test_suggestions(spark):
    from corpusloom.operators import workspace

    ask = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    types = spark.createDataFrame([("guidance",), ("policy_paper",), ("case_study",)], "slug string")
    got = {(r.id, r.slug, r["rank"]) for r in workspace.suggest_types(ask("guidances", "some policies", "Cases", None, "stats and press"), types).collect()}
    assert got == {(0, "guidance", 0), (1, "policy_paper", 0), (2, "case_study", 0), (4, "statistics", 1), (4, "press_release", 1)}
    orgs = spark.createDataFrame([("river-agency", "River Agency", "RA"), ("wild-north", "Wild North", None), ("fields", "River, Food and Rural Affairs", "FIELDS")], "slug string, title string, acronym string")
    found = {r.id: [] for r in ask("", "", "", "").collect()}
    for r in workspace.suggest_organisations(ask("RA office", "the river agency", "wild, rural", "agency"), orgs).orderBy("id", "rank").collect():
        found[r.id].append(r.slug)
    assert found == {0: ["river-agency"], 1: ["fields", "river-agency"], 2: ["wild-north", "fields"], 3: []}
    saved = spark.createDataFrame([(1, "guidance, guidances", "")], "id int, types string, orgs string")
    assert [tuple(r) for r in workspace.unknown_entries(saved, "types", types, lambda a: workspace.suggest_types(a, types)).collect()] == [(1, "guidances", "guidance")]
    assert workspace.unknown_entries(saved, "types", types.limit(0), lambda a: workspace.suggest_types(a, types)).count() == 0


def test_decisions(spark):
    from corpusloom.functions.replies import parse_decision

    read = lambda t: tuple(one(spark, t, parse_decision))
    none = (None,) * 6
    assert read(None) == read("") == read("no {json} here") == none
    assert read('{"keep": true, "score": "0.5", "reason": null}') == (1, 0.5, "", None, None, None)
    assert read('```json\n{"keep": 0, "score": 1, "reason": "a } b"}\n```') == (0, 1.0, "a } b", None, None, None)
    assert read('think {"keep": 0} more {"keep": 1, "where": "title", "evidence": ["q", 2], "primary_topic": "  t "} end {"x": 1}') == (1, None, "", "t", ["title"], ["q", "2"])
    assert read('{"score": "high"}') == (None, None, "", None, None, None)
    long = read('{"keep": 1, "reason": "%s", "primary_topic": "%s", "evidence": [%s]}' % ("r" * 2000, "t" * 300, ", ".join(['"%s"' % ("e" * 600)] * 60)))
    assert (len(long[2]), len(long[3]), len(long[5]), len(long[5][0])) == (1000, 200, 50, 500)


def test_consensus(spark):
    votes = spark.createDataFrame(
        [("u1", "a", "in", "x"), ("u2", "b", "in", "y"), ("u2", "a", "in", None), ("u3", "a", "in", "p"), ("u3", "b", "out", "q"), ("u4", "a", "in", "p"), ("u4", "b", "out", "q"), ("u4", "c", "in", "r")],
        "url string, labeller string, label string, rationale string",
    )
    got = {r.url: (r.label, r.agreement, r.n_votes, r.rationale, r.labelled_by) for r in gold.consensus(votes).collect()}
    assert got == {"u1": ("in", "single", 1, "x", "a"), "u2": ("in", "unanimous", 2, "a: in —  | b: in — y", "a, b"), "u3": ("borderline", "split", 2, "a: in — p | b: out — q", "a, b"), "u4": ("in", "majority", 3, "a: in — p | b: out — q | c: in — r", "a, b, c")}
    settled = spark.createDataFrame([("u3", "out", "note"), ("u9", "in", "old")], "url string, label string, rationale string")
    stored = spark.createDataFrame([("u1", "in", "single", "x", 1, 7), ("u3", "borderline", "split", "", 2, 2)], "url string, label string, agreement string, rationale string, n_votes long, version int")
    got = {r.url: (r.label, r.agreement, r.n_votes, r.version) for r in gold.consensus(votes, settled, stored).collect()}
    assert got["u3"] == ("out", "adjudicated", 2, 3) and got["u9"] == ("in", "adjudicated", 0, 1) and got["u1"] == ("in", "single", 1, 7) and got["u2"][3] == 1
    row = gold.agreement_summary(votes.withColumn("blind", F.col("labeller") == "c")).first()
    assert (row.labellers, row.pages_voted, row.pages_multi, row.pages_complete, row.unanimous, row.blind_votes) == (3, 4, 3, 1, 1, 1)
    assert {r.url: r.votes for r in gold.disagreements(votes).collect()} == {"u3": "a=in,b=out", "u4": "a=in,b=out,c=in"}


def test_fleiss_and_calibration(spark):
    from corpusloom.functions import bands
    from corpusloom.operators import metrics

    kappa = lambda rows: metrics.fleiss_kappa(spark.createDataFrame(rows, "url string, keep int")).first().kappa
    assert kappa([("a", 1), ("a", 1), ("b", 0), ("b", None)]) == 1.0 and kappa([("a", 1), ("a", 1)]) == 1.0
    assert kappa([("a", 1), ("b", 0)]) is None and kappa([("a", 1), ("a", 1), ("b", 0)]) is None and kappa([]) is None
    assert kappa([("a", 1), ("a", 0), ("b", 0), ("b", 0)]) == pytest.approx((0.5 - 0.625) / 0.375)
    labels = spark.createDataFrame([("a", "in"), ("b", "out"), ("c", "in"), ("d", "out"), ("e", "borderline")], "url string, label string")
    scores = lambda *v: spark.createDataFrame(list(zip("abcde", v)), "url string, score double")
    table = lambda *v: {r.band: (r.n, r.share_in, r.monotone, r.brier) for r in metrics.calibration(labels, scores(*v), bands.score_band(F.col("score")), bands.BAND_ORDER).collect()}
    assert table(0.9, 0.0, 0.5, None, 0.1) == {"0.7-1.0": (1, 1.0, True, pytest.approx((0.01 + 0.25) / 3)), "0": (1, 0.0, True, pytest.approx(0.26 / 3)), "0.4-0.6": (1, 1.0, True, pytest.approx(0.26 / 3)), "unscored": (1, 0.0, True, pytest.approx(0.26 / 3))}
    assert table(0.1, 0.9, 0.1, 0.9, 0.1)["0.7-1.0"][2] is False and table(0.9, 0.9, 0.9, 0.9, None)["0.7-1.0"][2] is None
    weighted = metrics.confusion(labels.withColumn("w", F.lit(2.5)), spark.createDataFrame([("a", 1), ("b", None)], "url string, keep int"), "w").where("bound = 'exclude'").first()
    assert (weighted.tp, weighted.fn, weighted.tn, weighted.n, weighted.unparsed) == (2.5, 2.5, 5.0, 10.0, 7.5)


def test_bootstrap(spark):
    from corpusloom.operators import metrics

    labels = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 2 == 0, "in").otherwise("out").alias("label"))
    keeps = lambda n: labels.select("url", F.when(F.substring("url", 2, 9).cast("int") % n != 0, 1).otherwise(0).alias("keep"))
    row = metrics.bootstrap(labels, keeps(10), metric="recall").first()
    assert row.point == pytest.approx(0.8) and 0.7 < row.low < 0.8 < row.high < 0.9 and row.draws == 2000
    assert tuple(metrics.bootstrap(labels, keeps(10), metric="recall").first()) == tuple(row)
    other = metrics.bootstrap(labels, keeps(10), keeps(4), "recall").first()
    assert other.point == pytest.approx(0.3) and other.low < 0.3 < other.high
    empty = metrics.bootstrap(labels.where("label = 'out'"), keeps(10), metric="recall").first()
    assert tuple(empty) == (None, None, None, 0)


def test_grounding(spark):
    from corpusloom.operators import review

    cols = "keep int, score double, evidence array<string>, where_hit array<string>, primary_topic string, title string, description string, body string, include_text string, truncated boolean"
    rows = [
        (1, 0.8, ["“Store  Slurry”"], ["body"], "slurry", "t", None, 'you must "store slurry" well', "Pages about farms. More.", False), (1, 0.8, ["not there"], ["footer"], "pages about farms", "t", None, "b", "Pages about farms. More.", True),
        (0, 0.0, None, None, " ".join(["w"] * 11), "t", "d", "b", "", None), (None, None, None, None, None, None, None, None, None, True), (1, 1.5, [" "], [], "", "t", "d", "b", "x", False), (1, 0.0, ["ﬁne"], ["title", "description"], "t", "Fine title", None, "fine", "", False),
    ]
    got = [tuple(r[k] for k in review.CHECKS) for r in review.grounding_checks(spark.createDataFrame(rows, cols)).collect()]
    assert got == [(True,) * 7, (True, True, False, False, False, True, False), (True, True, None, None, False, True, True), (False, None, None, None, None, None, False), (True, True, False, False, False, False, True), (True, False, True, False, True, True, True)]
    assert {r.check: (r.n, r.passed) for r in review.grounding(spark.createDataFrame(rows, cols)).collect()}["G3_evidence_verbatim"] == (4, 2)


def test_runs_and_stages(spark):
    from corpusloom.operators import review, runs

    results = spark.createDataFrame([("r", "/a", 1, 5, 0.2), ("r", "/b", 0, 7, 0.0), ("r", "/c", None, 1, None)], "run_id string, url string, keep int, ms long, score double")
    usage = spark.createDataFrame([("r", 0.5, 10, 1, 4, 6), ("r", 0.25, 1, 1, 0, 1)], "run_id string, cost double, in_tokens long, out_tokens long, hit_tokens long, miss_tokens long")
    assert tuple(runs.run_totals(results, usage).first()) == ("r", 3, 1, 1, 1, 13, 0.75, 11, 2, 4, 7) and runs.run_totals(results, usage.limit(0)).first().cost == 0
    some = spark.createDataFrame([("/a",)], "url string")
    second = spark.createDataFrame([("/a", 0)], "url string, keep int")
    stages = lambda second: {(r.url, r.stage) for r in review.stage_rows(results, second, some, some, some).collect()}
    assert {("/a", "excl_final"), ("/b", "excl_include"), ("/c", "reached_inclusion"), ("/a", "reached_exclusion")} <= stages(second) and ("/a", "final") not in stages(second)
    assert ("/a", "final") in stages(second.limit(0))
    left = runs.recounted(spark.createDataFrame([("r",), ("s",)], "run_id string"), results.where("url <> '/b'"))
    assert sorted(map(tuple, left.collect())) == [("r", 2, 1, 0), ("s", 0, 0, 0)]
    chain = (results, second)
    row = runs.overall_compare(chain, (results.withColumn("keep", F.lit(1)), second.limit(0))).first()
    assert (row.shared, row.both_in, row.both_out, row.base_only, row.other_only, row.agreement) == (3, 0, 0, 0, 3, 0.0)
    row = runs.discriminability(results).first()
    assert (row.scored, row.kept, row.borderline_keeps, row.borderline_pct, row.top_score, row.top_share) == (2, 1, 1, 100.0, 0.2, 100.0)

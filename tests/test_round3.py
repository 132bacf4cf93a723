"""Values known from outside, interrupted and repeated work, long chains, doubled inputs, and stored indexes against brute force."""

import math
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import english, replies
from corpusloom.functions.html import html_text
from corpusloom.operators import bench, filters, hierarchy, ingest, metrics, paths, phrases, review, runs, scoring, sketches, workspace
from corpusloom.sources.scratch import checkpoint_dir
from corpusloom.streaming import streams


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first().r


def folder(spark, name):
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


GOLD = [("a", "in"), ("b", "in"), ("c", "out"), ("d", "out"), ("e", "borderline"), ("f", "in")]
FIRST = [("a", 1), ("b", 0), ("c", 1), ("d", 0), ("e", 1), ("f", None)]


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame(GOLD, "url string, label string")


def kept(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "url string, keep int, score double")


def test_quality(spark, gold):
    got = {r.bound: r for r in metrics.rates(metrics.confusion(gold, kept(spark, FIRST))).collect()}
    d = got["exclude"]
    assert (d.tp, d.fp, d.fn, d.tn, d.n, d.unparsed, d.precision, d.recall, d.specificity) == (1, 1, 2, 1, 5, 1, 0.5, pytest.approx(1 / 3), 0.5)
    assert got["in"].tp == 2 and got["out"].fp == 2


def test_second_phase(spark, gold):
    first = kept(spark, [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 0), ("f", None), ("g", 1)])
    second = kept(spark, [("a", 1), ("b", 0), ("c", 0), ("d", None)])
    assert {r.url: r.keep for r in review.end_to_end(first, second).collect()} == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 0, "f": None, "g": 1}
    got = {r.bound: r for r in metrics.value_add(gold, first, second).collect()}
    d = got["exclude"]  # an unparsed second verdict drops nothing
    assert (d.p1_keeps, d.p2_drops, d.fp_removed, d.tp_lost, d.net, d.drop_precision, d.lost_share) == (4, 2, 1, 1, 0, 0.5, pytest.approx(1 / 3))
    assert got["in"].lost_share == 0.25
    none = {r.bound: r for r in metrics.value_add(gold, kept(spark, [("a", 0)]), second).collect()}
    assert none["exclude"].drop_precision is None and none["exclude"].p1_keeps == 0


def test_majority_counts_missing_repeats(spark):
    rows = [("r1", "a", 1), ("r2", "a", None), ("r3", "a", 0), ("r1", "b", 1), ("r2", "b", 1), ("r1", "c", None), ("r1", "d", 1), ("r4", "e", 1), ("r3", "e", 1)]
    repeats = spark.createDataFrame(rows, "run_id string, url string, keep int")
    assert {r.url: r.keep for r in metrics.majority(repeats).collect()} == {"a": 0, "b": 1, "c": None, "d": 0, "e": 1}
    assert {r.url: r.keep for r in metrics.majority(repeats, 2).collect()}["d"] == 1


def test_cohens_h_is_signed(spark):
    a, b = kept(spark, [("a", 1), ("b", 0), ("c", 0), ("d", 0)]), kept(spark, [("a", 1), ("b", 1), ("c", 1), ("d", 0)])
    want = 2 * math.asin(math.sqrt(0.25)) - 2 * math.asin(math.sqrt(0.75))
    assert metrics.cohen_kappa(a, b).first().h == pytest.approx(want) and metrics.cohen_kappa(b, a).first().h == pytest.approx(-want)


@pytest.mark.parametrize("a, b, want", [(0, 0, None), (5, 0, 0.0625), (3, 3, 1.0), (8, 1, 0.0390625)])
def test_mcnemar(spark, a, b, want):
    n = a + b
    labels = spark.createDataFrame([(f"u{i}", "in") for i in range(n)] + [("z", "in")], "url string, label string")
    left = kept(spark, [(f"u{i}", int(i < a)) for i in range(n)] + [("z", 1)])
    right = kept(spark, [(f"u{i}", int(i >= a)) for i in range(n)] + [("z", 1)])
    row = metrics.mcnemar(labels, left, right).first()
    assert (row.only_a, row.only_b) == (a, b) and row.p == (want if want is None else pytest.approx(want))


def test_mcnemar_of_many_pages(spark):
    n = 200_000
    pages = spark.range(n).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("in").alias("label"), F.col("id"))
    a, b = pages.select("url", (F.col("id") % 2).cast("int").alias("keep")), pages.select("url", ((F.col("id") + 1) % 2).cast("int").alias("keep"))
    start = time.time()
    row = metrics.mcnemar(pages, a, b).first()
    assert (row.only_a, row.only_b, row.p) == (n // 2, n // 2, 1.0) and time.time() - start < 60


def test_bootstrap_draws(spark):
    """The draws of one cell have the mean and deviation of a binomial; one that is sure or impossible is exact."""
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    for n, p in ((10, 0.3), (400, 0.97), (100_000, 0.5)):
        got = u.select(metrics.binomial_draw(F.col("u"), F.lit(n).cast("bigint"), F.lit(p)).alias("k")).agg(F.avg("k"), F.stddev_pop("k"), F.min("k"), F.max("k")).first()
        assert got[0] == pytest.approx(n * p, rel=1e-3) and got[1] == pytest.approx(math.sqrt(n * p * (1 - p)), rel=0.02) and 0 <= got[2] and got[3] <= n
    sure = u.select(*[metrics.binomial_draw(F.col("u"), F.lit(n).cast("bigint"), F.lit(p)).alias(name) for name, n, p in (("a", 0, 0.5), ("b", 9, 0.0), ("c", 9, 1.0))]).distinct().collect()
    assert [tuple(r) for r in sure] == [(0, 0, 9)]


@pytest.mark.parametrize(
    "stage, verdict, label",
    [("kept", "correct", "in"), ("kept", "wrong", "out"), ("p1_drop", "correct", "out"), ("p2_drop", "wrong", "in"), ("p1_unparsed", "correct", None), ("p1_unparsed", "borderline", "borderline"), ("kept", "maybe", None), (None, "wrong", None)],
)
def test_labels_of_verdicts(spark, stage, verdict, label):
    row = spark.createDataFrame([(stage, verdict, label)], "s string, v string, l string").select(review.label_of_verdict(F.col("s"), F.col("v")).alias("l"), review.verdict_of_label(F.col("s"), F.col("l")).alias("v")).first()
    assert row.l == label and row.v == (verdict if label else None)


def test_latest_verdicts(spark):
    known = spark.createDataFrame([("i1", 1, "inclusion", None, "1"), ("i2", 1, "inclusion", None, "2"), ("e1", 1, "exclusion", "i2", "3"), ("e2", 1, "exclusion", "i2", "4"), ("e3", 1, "exclusion", "i1", "9"), ("j", 2, "inclusion", None, "1")], "run_id string, category_id long, phase string, source_run_id string, started_at string")
    rows = [("i1", "old", 1, 0.5, "r", "t"), ("i2", "a", 1, 0.9, "r", None), ("i2", "b", 1, 0.8, None, "t"), ("e1", "a", 1, None, "x", None), ("e2", "a", 0, None, "x", None), ("e2", "zz", 1, None, "x", None), ("j", "a", None, None, None, None)]
    results = spark.createDataFrame(rows, "run_id string, url string, keep int, score double, reason string, primary_topic string")
    got = {tuple(r) for r in review.latest_verdicts(known, results).collect()}
    assert got == {(1, "a", 0.9, 1, "r", "", 0), (1, "b", 0.8, 1, "", "t", None), (2, "a", None, None, "", "", None)}


def test_run_names(spark):
    rows = [(1, 7, None, "2026-09-15T01"), (2, 7, 1, "2026-09-15T02"), (3, 7, None, "2026-09-15T03"), (4, 7, None, "2026-09-16T00"), (5, 8, None, "2026-09-15T09")]
    got = {r.run_id: r.name for r in runs.run_names(spark.createDataFrame(rows, "run_id long, category_id long, source_run_id long, started_at string")).collect()}
    assert got == {1: "Run 26-09-15 - 1", 2: "Run 26-09-15 - 2", 3: "Run 26-09-15 - 2", 4: "Run 26-09-16 - 1", 5: "Run 26-09-15 - 1"}


def test_exclusion_replies(spark):
    read = lambda t: tuple(one(spark, t, replies.parse_exclusion))
    assert read('{"keep": false, "exclusion_hit": "homonym", "reason": "wrong slurry"}') == (0, None, "[homonym] wrong slurry")
    assert read('{"keep": true, "exclusion_hit": "none", "reason": "on topic"}') == (1, None, "on topic")
    assert read("garbage") == read('{"reason": "no verdict"}') == read(None) == (None, None, None)
    assert read('Hm {"x": 1}\n```json\n{"keep": 0, "exclusion_hit": " None ", "verdict_reason": "v"}\n```') == (0, None, "v")
    assert len(read('{"keep": 0, "reason": "%s"}' % ("r" * 3000))[2]) == 1000
    label = lambda t: tuple(spark.createDataFrame([(t,)], "x string").select(*replies.exclusion_label(F.col("x"))).first())
    assert label("[homonym] wrong") == ("Excluded as homonym", "wrong") and label("[Wrong_Domain] x") == ("Excluded as wrong domain", "x")
    assert label("[fees] x") == ("KEPT", "[fees] x") and label("plain") == ("KEPT", "plain") and label(None) == ("KEPT", "")


def test_quotes(spark):
    found = lambda t: one(spark, t, replies.quotes)
    assert found("the “slurry store,” and \"Slurry Store\" and 'x' in page's 'own words' it's ‘so.’ \"12\"") == ["slurry store", "own words", "so"]
    assert found(None) == [] and found('"a\nb"') == []


def test_long_reply(spark):
    """Ten times the braces take no more than about ten times the time."""
    took = []
    for n in (200, 200, 2000):
        text = '{"keep": 0} ' + "{x} " * n + '{"keep": 1}'
        start = time.time()
        assert one(spark, text, replies.parse_decision).keep == 1
        took.append(time.time() - start)
    assert took[2] < 15 * took[1] + 5


def test_payload_fields(spark):
    read = lambda t: spark.createDataFrame([(t,)], "x string").select(*ingest.extract_fields(F.col("x"))).first()
    row = read('{"schema_name": "redirect", "withdrawn_notice": {}, "redirects": [{"destination": "/a/b/?q=1"}]}')
    assert (row.is_redirect, row.withdrawn, row.destination, row.title, row.content_id, row.document_type) == (True, False, "https://www.example.org/a/b", "", None, "")
    row = read('{"document_type": "guide", "withdrawn_notice": {"explanation": "x"}, "redirects": [{"destination": "https://other.example/"}], "content_id": "", "description": "d"}')
    assert (row.is_redirect, row.withdrawn, row.destination, row.content_id, row.description) == (False, True, None, None, "d")
    assert read("{bad").document_type == "" and read(None).withdrawn is False


def test_html_like_the_standard_parser(spark):
    cases = {"&amp;lt;b&amp;gt; &#128; &#xD800; &#0; &notit; &copy 1": "<b> € � � ¬it; © 1", "a<br/>b<li/>c<p>d": "a b cd", '<a title="x>y">t</a>': "t", "<style>p{}</style ><script>if (a<b) {}</script>z<!-- c --!>": "z", "x   y": "x y"}
    df = spark.createDataFrame(list(cases.items()), "x string, want string")
    assert all(r.got == r.want for r in df.select("want", html_text(F.col("x")).alias("got")).collect())


def test_links_of_long_pages(spark):
    took = []
    for n in (2000, 2000, 16_000):
        page = "".join(f'<a href="/d/{k % (n // 2)}">{k}</a>' for k in range(n))
        start = time.time()
        found = spark.createDataFrame([(page,)], "h string").select(ingest.body_links(F.array("h"), limit=100_000).alias("l")).first().l
        took.append(time.time() - start)
        assert [(x.href, x.text) for x in found] == [(f"https://www.example.org/d/{k}", str(k)) for k in range(n // 2)]
    assert took[2] < 16 * took[1] + 5


# Stored phrases
def test_units(spark):
    texts = ["Foo-bar baz", "mail a.b+c@x-y.example.com now", "see www.example.org/a/b?c and example.org", "v1.2.3 is 3.14", "x_y ÉLAN it's", "", "-- . a-", "a--b c-d-e"]
    got = [r.u for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(phrases.unit_list(F.col("t")).alias("u")).collect()]
    assert got == [english.units(t) for t in texts]
    assert got[0] == ["foo-bar", "foo", "bar", "baz"] and got[1][1] == "a.b+c@x-y.example.com" and got[2] == ["see", "www.example.org/a/b?c", "www.example.org", "/a/b?c", "and", "example.org"]


def test_phrase_index(spark):
    rng = random.Random(1)
    words = ["food", "foods", "thought", "thoughts", "farm", "farming", "for", "the", "slurry-store", "store", "a@b.example.com"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    pages = {f"u{i}": text() for i in range(60)}
    index = phrases.PhraseIndex(spark, folder(spark, "phrases"), 4)
    table = lambda d: spark.createDataFrame(list(d.items()), "url string, text string")
    terms = ["food for thought", "farms", "slurry-store", "the", "store food", "a@b.example.com"]

    def want(match):
        out = {}
        for url, t in pages.items():
            stems = [english.stem(w) for w in english.units(t)]
            hits = []
            for term in terms:
                asked = english.phrase(term)
                if asked and any(all(i + o < len(stems) and stems[i + o] == s for o, s in asked) for i in range(len(stems))):
                    hits.append(term)
            if hits and (match == "any" or len(hits) == 5):
                out[url] = hits
        return out

    found = lambda match: {r.url: r.hits for r in index.search(terms, match).collect()}
    index.add(table(pages), 0)
    assert found("any") == want("any") and found("all") == want("all")
    changed = {f"u{i}": text() for i in range(0, 60, 7)} | {"new": "food thought store"}
    pages |= changed
    index.add(table(pages), 1)
    assert found("any") == want("any")
    # Only what changed was written, and the batch may be written again.
    assert {r.url for r in spark.read.parquet(f"{index.path}/pages/batch=1").collect()} <= set(changed)
    index.add(table(pages), 1)
    assert found("any") == want("any")
    index.remove(spark.createDataFrame([("u1",), ("u2",)], "url string"), 2)
    del pages["u1"], pages["u2"]
    assert found("any") == want("any")
    plan = index.postings(["food"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "EqualTo(stem,food)" in plan
    index = index.compact(folder(spark, "phrases"))
    assert found("any") == want("any") and index.postings().select("batch").distinct().count() == 1
    assert index.search(["the", ""]).count() == 0
    assert phrases.PhraseIndex(spark, folder(spark, "none")).search(["food"]).count() == 0


# Runs that are scored
def test_scoring_goes_on(spark):
    asked = spark.sparkContext.accumulator(0)

    def scorer(pages):
        asked.add(len(pages))
        if (pages["text"] == "bad").any():
            raise ValueError("no answer")
        return pd.DataFrame({"keep": pages["text"].str.contains("x").astype(int), "reason": "r:" + pages["text"]})

    rows = [(f"u{i}", "bad" if i % 10 == 0 else f"page {'x' * (i % 2)}") for i in range(60)] + [("u1", "page x"), (None, "lost")]
    pages = spark.createDataFrame(rows, "url string, text string")
    run = scoring.ScoringRun(spark, folder(spark, "run"), 4)
    run.score(pages, scorer, parts=[0, 1])
    some = run.results().count()
    assert 0 < some < 60
    run.score(pages, scorer)
    first = {r.url: (r.keep, r.reason, r.error) for r in run.results().collect()}
    assert len(first) == 60 and first["u1"] == (1, "r:page x", None) and first["u2"] == (0, "r:page ", None) and first["u10"] == (None, None, "ValueError: no answer")
    before = asked.value
    run.score(pages, scorer)  # nothing is asked twice
    assert asked.value == before and {r.url: (r.keep, r.reason, r.error) for r in run.results().collect()} == first
    run.score(pages, lambda p: pd.DataFrame({"keep": [1] * len(p), "score": [0.5] * len(p)}), again=True)
    after = {r.url: (r.keep, r.error) for r in run.results().collect()}
    assert after["u10"] == (1, None) and after["u2"] == (0, None)
    assert scoring.score_batch(pd.DataFrame({"url": ["a", "b"], "text": ["t", "t"]}), lambda p: pd.DataFrame({"keep": [7] * len(p)}))["keep"].isna().all()
    empty = scoring.ScoringRun(spark, folder(spark, "run"))
    empty.score(pages.limit(0), scorer)
    assert empty.results().count() == 0
    with pytest.raises(ValueError):
        scoring.keyword_scorer([])


# Selections
def test_many_selections(spark):
    rng = random.Random(2)
    words, orgs, types = [f"w{k}" for k in range(40)], list("abcde"), ["guidance", "news_story", "html_publication"]
    rows, links = [], []
    for i in range(120):
        rows.append((f"u{i}", f"k{i // 2}" if i % 3 else None, rng.choice([*types, None]), rng.choice(["guidance", "", None]), i % 11 == 0, "h", False, " ".join(rng.sample(words, 4)).upper(), None, None))
        links += [(f"u{i}", o) for o in rng.sample(orgs, rng.randint(0, 2))]
    pages = spark.createDataFrame(rows, "url string, content_id string, document_type string, parent_document_type string, is_redirect boolean, content_hash string, withdrawn boolean, title string, description string, search_text string")
    held = spark.createDataFrame(links, "url string, organisation_slug string")
    specs = [(k, ", ".join(rng.sample(orgs, rng.choice([0, 1, 2]))), ",".join(rng.sample(types, rng.choice([0, 1]))), "\n".join(rng.sample(words, rng.choice([0, 1, 3])))) for k in range(400)] + [(400, "", "", ""), (401, None, None, "W1, w1"), (402, "nobody", "", "")]
    selections = spark.createDataFrame(specs, "id long, orgs string, types string, words string")
    split = lambda t: {x.strip() for x in re.split("[,\n]", t or "")} - {""}
    of = {}
    for url, o in links:
        of.setdefault(url, set()).add(o)
    want = {}
    for k, o, t, w in specs:
        for url, key, kind, parent, redirect, _, _, title, *_ in rows:
            kinds = {parent if kind == "html_publication" and parent else kind} | ({"html_publication"} if kind == "html_publication" else set())
            if not redirect and (not split(o) or split(o) & of.get(url, set())) and (not split(t) or split(t) & kinds) and (not split(w) or any(x.lower() in title.lower() for x in split(w))):
                at = (k, key or url)
                want[at] = min(want.get(at, url), url)
    got = {(r.category_id, r.content_id): r.url for r in workspace.refresh(pages, held, selections).collect()}
    assert got == want
    assert workspace.refresh(pages, held, selections.limit(0)).count() == 0 and workspace.refresh(pages.limit(0), held, selections).count() == 0
    hits = lambda n: sorted(map(tuple, workspace.keyword_hits(pages.select("url", filters.keyword_text().alias("text")), spark.createDataFrame([(w,) for w in words], "word string"), n).collect()))
    assert hits(20) == hits(10_000)


def test_hundred_thousand_selections(spark):
    pages = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(None).cast("string").alias("content_id"), F.lit("guidance").alias("document_type"), F.lit("").alias("parent_document_type"), F.lit(False).alias("is_redirect"), F.lit("h").alias("content_hash"), F.lit(False).alias("withdrawn"), F.concat(F.lit("<"), "id", F.lit(">")).alias("title"), F.lit("").alias("description"), F.lit("").alias("search_text"))
    links = pages.select("url", F.lit("o").alias("organisation_slug"))
    selections = spark.range(100_000).select("id", F.when(F.col("id") % 2 == 0, "o").otherwise("other").alias("orgs"), F.lit("").alias("types"), F.concat(F.lit("<"), F.col("id") % 1000, F.lit(">")).alias("words"))
    assert workspace.refresh(pages, links, selections).count() == 150 * 100


# Change logs
def test_page_log(spark):
    path = folder(spark, "log")
    schema = "raw_url string, http_status int, body string, seq long"
    log = streams.page_log(spark, f"{path}/pages")
    state = lambda: {r.url.rpartition("/")[2]: (r.source, r.first_seen, r.last_seen, r.last_changed) for r in streams.pages_of(log).collect()}
    assert state() == {}
    batches = [[("https://example.org/a", 200, "1", 1), ("https://example.org/a", 200, "2", 2), ("https://example.org/b", 404, "", 3), ("bad", 200, "", 4)], [("https://example.org/a", 200, "1", 1), ("https://example.org/c", 200, "x", 2)], [("https://example.org/a", 200, "3", 1)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        streams.ingest_payloads(spark.readStream.schema(schema).parquet(f"{path}/in"), log)
        assert log.batches()[-1] == k
    want = {"a": ("stream", "0", "2", "2"), "c": ("stream", "1", "1", "1")}
    assert state() == want
    # A batch that comes again changes nothing, and a batch has its own rows only.
    again = log.log().where("batch = 1").drop("batch")
    assert again.count() == 2
    log.write(spark.createDataFrame(again.collect(), again.schema), 1)
    assert state() == want
    log.compact(streams.pages_of(log, 1), 1)
    assert state() == want and log.batches() == [2] and log.version() == 1
    log.write(spark.createDataFrame([("https://www.example.org/z", "h", "late", "0")], streams.FETCHED), 0)
    assert state() == want  # it is in the base's time
    log.compact(streams.pages_of(log), 2)
    assert state() == want and log.batches() == [] and log.version() == 2


def test_page_log_batches_are_small(spark):
    path = folder(spark, "log")
    log = streams.page_log(spark, path)
    rows = lambda n, at: spark.range(n).select(F.concat(F.lit("https://www.example.org/"), "id").alias("url"), F.sha2(F.concat(F.lit(at), "id"), 256).alias("content_hash"), F.lit("s").alias("source"), F.lit(at).alias("seen_at"))
    log.write(rows(50_000, "0"), 0)
    log.write(rows(50, "1"), 1)
    size = lambda n: spark.read.format("binaryFile").load(f"{path}/log/batch={n}/*.parquet").agg(F.sum("length")).first()[0]
    assert size(1) < size(0) / 50 and streams.pages_of(log).count() == 50_000


def test_run_totals_log(spark):
    path = folder(spark, "totals")
    schema = "run_id string, url string, keep int, cost double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    keep = lambda: streams.keep_run_totals(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/totals")
    put([("a", "1", 1, 1.0), ("a", "2", 0, 1.0), ("b", "1", None, 2.0)])
    keep()
    put([("a", "3", 1, 0.5), ("a", "1", 1, 9.0)])
    log = keep()
    want = {"a": (2, 1, 0, 2.5), "b": (0, 0, 1, 2.0)}
    assert {r.run_id: tuple(r)[1:] for r in log.newest(["run_id"]).collect()} == want
    assert [r.run_id for r in log.log().where("batch = 1").collect()] == ["a"]  # only the run that changed
    assert {r.run_id: tuple(r)[1:] for r in keep().newest(["run_id"]).collect()} == want


# Chains
def test_long_chains(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("run_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("source_run_id"))
    row = runs.run_roots(chain).agg(F.max("depth"), F.min("root"), F.max("root"), F.sum((F.col("depth") == F.col("run_id")).cast("int"))).first()
    assert tuple(row) == (n - 1, 0, 0, n)
    odd = spark.createDataFrame([(5, 4), (4, 3), (3, 5), (9, 5), (8, 9), (1, 77), (2, None)], "run_id long, source_run_id long")
    assert {r.run_id: (r.root, r.depth) for r in runs.run_roots(odd).collect()} == {5: (3, None), 4: (3, None), 3: (3, None), 9: (3, None), 8: (3, None), 1: (77, 1), 2: (2, 0)}
    assert paths.follow(spark.createDataFrame([], "node long, next long")).count() == 0


def test_deep_forest(spark):
    n = 500
    edges = spark.range(1, n).select(F.format_string("s%04d", F.col("id") - 1).alias("parent"), F.format_string("s%04d", "id").alias("child"))
    ring = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "q"), ("q", "r")], "parent string, child string")
    got = {r.slug: (r.parent, r.depth) for r in hierarchy.forest(edges.union(ring), spark.createDataFrame([("s0001", 3)], "slug string, pages long")).collect()}
    assert len(got) == n + 5 and got["s0499"] == ("s0498", 499) and got["s0000"] == (None, 0)
    assert {k: got[k] for k in "xyzqr"} == {"x": (None, 0), "y": (None, 0), "z": (None, 0), "q": ("z", 1), "r": ("q", 2)}


def test_common_words_name_no_organisation(spark):
    known = spark.createDataFrame([("that-office", "About pages", "WITH"), ("rivers", "River pages", None)], "slug string, title string, acronym string")
    asked = spark.createDataFrame([(1, "that with about pages this from"), (2, "river documents")], "id int, text string")
    assert len(workspace.COMMON) == 47
    assert [(r.id, r.slug) for r in workspace.suggest_organisations(asked, known).collect()] == [(2, "rivers")]


def test_sketches(spark):
    """Within three of the stated errors of the exact counts, merged from two loads; exact below the entries kept."""
    page = lambda n, at: spark.range(at, at + n).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("k"), (F.col("id") / 2).cast("long")).alias("content_id"), F.lit("guidance").alias("document_type"), F.lit("").alias("parent_document_type"), F.lit(False).alias("is_redirect"), F.lit("h").alias("content_hash"), F.lit(False).alias("withdrawn"), F.col("id"))
    link = lambda df: df.select("url", F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("organisation_slug"))
    made = [sketches.page_sketches(p, link(p), 12) for p in (page(120_000, 0), page(120_000, 60_000))]
    both = sketches.merged(made[0].unionAll(made[1]), ["organisation_slug", "document_type"], 12)
    n = lambda *a: sketches.approximate_count(both, *a, entries=12).first().n
    assert n() == pytest.approx(90_000, rel=3 / 64) and n(["a"]) == pytest.approx(45_000, rel=3 / 64) and n(["c"]) == 0 and n([], ["other"]) == 0
    few = page(400, 0)
    assert sketches.approximate_count(sketches.page_sketches(few, link(few))).first().n == 200
    assert sketches.page_sketches(few.limit(0), link(few)).count() == 0


def test_outcomes(spark):
    """States, codes and sentences of runs, as users read them."""
    rows = [(1, 1, "inclusion", None, "1", True), (2, 2, "inclusion", None, "1", True), (3, 3, "inclusion", None, "1", False), (4, 4, "inclusion", None, "1", True), (5, 4, "exclusion", 4, "2", True), (6, 5, "inclusion", None, "1", True), (7, 6, "inclusion", None, "1", True)]
    known = spark.createDataFrame(rows, "run_id long, category_id long, phase string, source_run_id long, started_at string, finished boolean")
    totals = spark.createDataFrame([(1, 1200, 5, 1195), (2, 10, 4, 6), (4, 10, 4, 6), (5, 4, 2, 2), (6, 3, 0, 3)], "run_id long, pages long, kept long, dropped long")
    active = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 5), (5, 6), (6, 7)], "category_id long, run_id long")
    chains = bench.active_chains(known, active, totals, spark.createDataFrame([(1, 2500), (2, 10), (3, 1), (4, 10), (5, 9), (6, 1)], "category_id long, shortlist_total long"), spark.createDataFrame([(3,)], "run_id long"))
    said = {r.active_run: (r.status, r.message) for r in chains.select("active_run", "status", "message").distinct().collect()}
    assert said[1] == ("incomplete", "inclusion evaluated 1,200 of 2,500 — 1,300 still to do (input ≠ kept + dropped).")
    assert said[2] == ("incomplete", "Phase 2 (Exclusion) hasn't run over the 4 kept pages.") and said[3] == ("in_progress", "inclusion is still in progress.") and said[5] == ("complete", None)
    stops = spark.createDataFrame([(1, "done", "cap"), (2, "stopped", None), (3, "running", None), (5, "stopped", "error"), (6, "done", "balance")], "run_id long, status string, stop_reason string")
    results = spark.createDataFrame([(4, None, "length"), (5, 1, "max_tokens"), (5, None, None)], "run_id long, keep int, stop_reason string")
    got = {r.run_id: r for r in bench.run_outcomes(chains, stops, results, "Look.").collect()}
    assert (got[1].label, got[1].kind, got[1].why) == ("Did not complete", "warn", f"{said[1][1]} {bench.CAP}")
    assert got[2].why == bench.UNKNOWN_STOP and (got[3].label, got[3].kind, got[3].why) == ("Not started", "muted", None)
    assert (got[5].label, got[5].kind, got[5].why, got[5].unparsed, got[5].truncated, got[5].stop_reason) == ("Completed", "good", None, 2, 2, None)
    assert got[6].kind == "bad" and "Look. Top up" in got[6].why and got[7].label == "Not started"

"""Benchmark joins and active runs on nulls, ties, broken stamps and empty tables."""

from corpusloom.operators import bench

RUNS = "run_id string, name string, phase string, source_run_id string, started_at string, spec string"
OK = '{"scope":{"sha":"g"},"bench":{"p1":"m"%s},"template_hash":"t"}'


def test_bench_join(spark):
    rows = [
        ("a", "bench/1", "inclusion", None, "1", OK % ""),
        ("b", "bench/2", "exclusion", "a", "2", OK % ',"p2":"n"'),
        ("c", "bench/3", "exclusion", "a", "2", OK % ',"p2":"n"'),
        ("d", "bench/4", "inclusion", None, "1", "{broken"),
        ("e", "bench/5", "inclusion", None, "1", None),
        ("f", None, "inclusion", None, "1", OK % ""),
        ("g", "bench/6", "inclusion", None, "1", '{"scope":{"sha":"g"}}'),
    ]
    runs = bench.bench_runs(spark.createDataFrame(rows, RUNS), "g", {"inclusion": "t", "exclusion": "other"})
    assert sorted((r.run_id, r.repeat, r.mismatch) for r in runs.collect()) == [("a", 0, False), ("b", 0, True), ("c", 0, True)]
    gold = spark.createDataFrame([("u", "in", "h"), ("v", "out", None), ("w", "in", "h"), ("x", None, "h")], "url string, label string, content_hash_at_label string")
    results = spark.createDataFrame([("a", "u", 1, "h"), ("c", "u", 0, None), ("b", "u", 1, "h"), ("a", "v", None, "k"), ("a", "w", 1, "k"), ("d", "x", 1, "k")], "run_id string, url string, keep int, content_hash string")
    out = bench.bench_join(runs, results, gold)
    assert sorted((r.url, r.p2, r.keep1, r.keep2, r.mismatch) for r in out.collect()) == [("u", "n", 1, 0, True), ("v", "n", None, None, True), ("x", "n", None, None, True)]
    total = bench.per_run(out).first()
    assert (total.tp, total.fp, total.fn, total.tn, total.unparsed) == (0, 0, 1, 0, 2)
    assert bench.bench_join(runs, results.limit(0), gold).count() == 4
    assert bench.bench_join(runs, results, gold.limit(0)).count() == 0
    assert bench.bench_join(runs.limit(0), results, gold).count() == 0


def test_active_chains(spark):
    schema = "run_id int, category_id int, phase string, source_run_id int, started_at string, finished boolean"
    rows = [(1, 1, "inclusion", None, "1", True), (2, 1, "exclusion", 1, "2", True), (3, 2, "inclusion", None, "1", True), (4, 3, "inclusion", None, "1", None), (5, 4, "inclusion", None, "1", True), (6, 5, "inclusion", 99, "1", True)]
    totals = spark.createDataFrame([(1, 5, 3, 2), (2, 3, 1, 2), (3, 5, 3, 2), (5, 4, 1, 3)], "run_id int, pages long, kept long, dropped long")
    wanted = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5), (5, None)], "category_id int, shortlist_total long")
    active = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 77)], "category_id int, run_id int")
    runs = spark.createDataFrame(rows, schema)
    out = {r.run_id: (r.category_id, r.active_run, r.pages, r.status, r.reason) for r in bench.active_chains(runs, active, totals, wanted).collect()}
    assert out == {
        1: (1, 2, 5, "complete", None), 2: (1, 2, 3, "complete", None), 3: (2, 3, 5, "incomplete", "no exclusion"), 4: (3, 4, 0, "incomplete", "running"),
        5: (4, 5, 4, "incomplete", "short"), 6: (5, 6, 0, "complete", None),
    }
    assert bench.active_chains(runs.limit(0), active, totals, wanted).count() == 0

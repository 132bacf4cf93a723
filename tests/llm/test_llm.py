"""Each operator against brute force, and its edge cases: nulls, empties, long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, components, decontamination, exact_dedup, jaccard_join, language, line_dedup, packing, pii, quality, toxicity, url_filter
from corpusloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside, too."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"set_key": F.lit(1), "kept": F.lit("x"), "sum": F.lit(2), "key": F.lit(3), "rep": F.lit(4)})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


EDGE = [None, "", "   ", "...", "a", "a", "one two three four five six", "one two three four five six", "x " * 30_000, "word", None]


def shingles(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_oracles(spark, texts):
    import duckdb

    duck = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        found = duck.execute(sql)
        at = {c[0]: k for k, c in enumerate(found.description)}
        want = sorted(repr(tuple(r[at[c]] for c in sorted(df.columns))) for r in found.fetchall())
        assert sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect()) == want, name


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (5, 6), (6, 5), (None, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len({got[k] for k in range(301)}) == 1 and len({got[k] for k in range(1000, 1200)}) == 1 and got[0] != got[1000] and len(got) == 501
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_pii_base():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("a1@.+- (é2)\n%_", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"é{card}.") == [("card", 1, 20)]
    assert pii.base_spans("1.2.3.4.5.6.7.8 256.1.1.1 00000255.1.1.1") == brute_spans("1.2.3.4.5.6.7.8 256.1.1.1 00000255.1.1.1")
    assert len(pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@b.c")) == 1


def test_pii_field(spark, documents, texts):
    field = pii.fit(documents)
    examples = ["call (217) 555-7713 now", "write me1(at)mail7.example.com ok", "in 2024 and 1234567890", "host 10.20.30[.]40"]
    docs = docs_of(spark, EDGE + examples)
    rows = {r.doc_id: r for r in pii.find_pii(docs, field).collect()}
    assert len(rows) == len(EDGE) + len(examples)
    n = len(EDGE)
    assert rows[n].spans == "phone:5:19" and rows[n].n_phone == 0
    assert rows[n + 1].spans.startswith("email:6:")
    assert rows[n + 2].spans == ""
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.redacted("call (217) 555-7713 now", "phone:5:19") == "call [PHONE] now"
    base, every = zip(*(pii.all_spans(t, field) for t in texts.values()), strict=True)
    assert all(set(b) <= set(e) for b, e in zip(base, every, strict=True))


def test_pii_obfuscated_email(spark, documents):
    field = pii.fit(documents)
    texts = ["write john.doe(at)example.com now", "jane[at]mail.example.org", "look (at) this. And [at] that.", "john.doe(at)example.com, 10 and a@b.org", "to jd(at)example.com.", "(jd[at]example.com) ok"]
    assert [len(list(pii.islands(t))) for t in texts[:2]] == [1, 1]
    assert sum("(at)" in i.text for i, gold in pii.examples_of("to john.doe@example.com now") if gold) == 4
    got = [r.spans for r in pii.find_pii(docs_of(spark, texts), field).orderBy("doc_id").collect()]
    assert got == ["email:6:29", "email:0:24", "", "email:0:23,email:32:39", "email:3:20", "email:1:18"]


# 2
def test_toxicity(spark, documents):
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/labels.parquet")
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    met = toxicity.score_documents(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id")
    r = met.agg(F.avg((F.col("toxic") == F.col("is_toxic")).cast("int")).alias("accuracy"), F.sum(((F.col("is_toxic") == 1) & (F.col("toxic") == 0)).cast("int")).alias("wrong"), F.sum("is_toxic").alias("n")).first()
    assert r.accuracy > 0.93 and r.wrong <= 0.05 * r.n
    rows = toxicity.score_documents(docs_of(spark, EDGE), chain).collect()
    assert len(rows) == len(EDGE) and not any(x.is_toxic for x in rows)
    assert toxicity.score_documents(docs_of(spark, ["you idiot"]), toxicity.train([], ["a", "b"])).first().p_a == 0.5


def test_toxicity_categories(spark):
    """Recall and precision of each category on documents that the chain did not see; no given document holds a threat, so they are put in."""
    sf = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    rows = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").where("text IS NOT NULL").orderBy("doc_id").select("text", "lang", "toxic").collect()
    rest = [(r.text, r.lang, [*toxicity.seeds(r.text), r.toxic]) for r in rows]
    threats = [(f"{rest[k][0]} {word}", rest[k][1], [*rest[k][2][:2], 1, rest[k][2][3]]) for k, word in enumerate(2 * toxicity.SEEDS["threat"])]
    cases = [(lang, flags, [int(p >= toxicity.CUT) for p in chain.predict(toxicity.features(text))]) for text, lang, flags in rest + threats]

    def rates(k, langs):
        some = [(flags[k], found[k]) for lang, flags, found in cases if lang in langs]
        met = sum(a and b for a, b in some)
        return met / sum(a for a, _ in some), met / max(1, sum(b for _, b in some))

    figures = {(name, side): rates(k, langs) for k, name in enumerate(chain.names) for side, langs in (("en", {"en"}), ("other", {"de", "fr", "es"})) if name in ("threat", "toxic") or side == "en"}
    print(figures)
    assert all(recall >= 0.9 and precision >= 0.95 for recall, precision in figures.values()), figures
    assert all(chain.predict(toxicity.features(f"we {w} you"))[k] >= toxicity.CUT for k, words in enumerate(toxicity.SEEDS.values()) for w in words)
    assert chain.predict(toxicity.features("die Katze und die Maus sind hier in der Stadt"))[2] < toxicity.CUT


# 3
def test_urls(spark):
    rows = [("https://WWW.Example.com/en/1", "allow"), ("http://a.example.com/en/1?x", "block"), ("http://b.net/es/2", "block"), ("http://b.net/en/2", "allow"), ("http://x.org/1", "block"), ("http://y.org/1", "allow"), ("http://z.org/", "allow"), (None, "allow"), ("no url", "allow"), ("http://x.com", "allow"), ("http://x.com", "allow")]
    pages = spark.createDataFrame([(k, u, None) for k, (u, _) in enumerate(rows)], "page_id long, url string, html string").withColumn("node", F.lit(1))
    edges = spark.createDataFrame([("http://x.org/1", "http://b.net/es/2"), ("http://y.org/1", "http://k.net/fr/9"), ("http://y.org/1", "http://m.com/q"), (None, "http://z.org/")], "src string, dst string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, edges).collect()}
    assert [got[k].verdict for k in range(len(rows))] == [v for _, v in rows]
    assert got[0].host == "www.example.com" and got[0].rule == "www.example.com/en/" and got[7].host == got[8].path == ""
    html = spark.createDataFrame([(1, "http://p.org/1", '<link href="http://q.net/fr/1" rel="canonical">'), (2, "http://r.org/1", '<META http-equiv="Refresh" content="0; url=http://s.net/es/2">')], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(html, url_filter.page_edges(html)).collect()} == {1: "block", 2: "block"}
    assert url_filter.filter_urls(pages.limit(0), edges.limit(0)).count() == 0


def test_url_targets(spark):
    cases = [("/b?u=http://x.org/", "http://h.net/b?u=http://x.org/"), ("c", "http://h.net/fr/c"), ("../c/./d/..", "http://h.net/c/"), ("?q", "http://h.net/fr/a?q"), ("#f", "http://h.net/fr/a?p#f"), ("//o.org", "http://o.org"), ("HTTPS://O.org/x", "HTTPS://O.org/x"), ("mailto:a@b.org", None), ("http:///x", None), ("../../..", "http://h.net/")]
    got = spark.createDataFrame([(k, t, "http://h.net/fr/a?p#g") for k, (t, _) in enumerate(cases)], "k long, t string, base string").select("k", url_filter.resolved(F.col("t"), F.col("base")).alias("r"))
    assert [r.r for r in got.orderBy("k").collect()] == [want for _, want in cases]
    assert [r.r for r in spark.createDataFrame([("c", "http://h.net"), ("/c", "no url")], "t string, base string").select(url_filter.resolved(F.col("t"), F.col("base")).alias("r")).collect()] == ["http://h.net/c", None]
    link = lambda to: f'<link rel="canonical" href="{to}">'
    rows = [
        ("http://a.net/fr/1", link("/"), "block"), ("http://a.org/1", link("/"), "allow"), ("http://a.org/", None, "allow"), ("http://a.net/", None, "block"),  # one relative target, two sites
        ("http://k.net/es/2", link("https://www.b.org/x/"), "block"), ("https://b.org/x", None, "block"), ("http://m.b.org/x.html", None, "block"),  # a target's www. and http variants
        ("http://c.net/es/3", '<meta http-equiv=refresh content="0; url=../y">', "block"), ("https://www.c.net/y?q", None, "block"),
        ("http://d.net/es/4", '<base href="//e.org/p/">' + link("z"), "block"), ("https://e.org/p/z", None, "block"), ("https://d.net/es", None, "allow"),
        ("http://f.net/es/5", link("mailto:x@y.org"), "block"), ("http://f.org/6", link("mailto:x@y.org"), "allow"), (None, link("/"), "allow"),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.page_edges(pages)).collect()}
    assert [got[k] for k in range(len(rows))] == [v for _, _, v in rows]


# 4
def test_language(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    model = language.fit(docs)
    met = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert met.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    rows = {r.doc_id: r for r in language.identify(docs_of(spark, EDGE), model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (0, 1, 2, 3)) and rows[6].lang_pred in model.dictionaries
    assert language.identify(docs_of(spark, ["a"]), language.Compressors({})).first().lang_pred == "und"


# 5
def brute_links(texts, t=0.8):
    sets = {k: shingles(v) for k, v in texts.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def test_jaccard(spark, documents, texts):
    want = Counter(x for pair in brute_links(texts) for x in pair)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(documents).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: want[k] for k in texts}


def test_jaccard_large_group(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    texts = {}
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = f"x{rng.randrange(50)}"
        texts[k] = " ".join(words)
    want = Counter(x for pair in brute_links(texts) for x in pair)
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs_of(spark, list(texts.values())), block=16).collect()}
    assert got == {k: want[k] for k in texts}


def test_jaccard_edges(spark):
    docs = docs_of(spark, EDGE + ["same text", "same text"], [*range(len(EDGE)), None, None])
    rows = jaccard_join.jaccard_join(docs).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == len(EDGE) + 2 and by[0].n_links == 0 and by[0].class_id == 0 and by[5].class_id == 4 and by[7].class_id == 6
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter({None: 2, "": 1, "   ": 1, "...": 1, "a": 1, EDGE[6]: 1, EDGE[8]: 1, "word": 1, "same text": 1})
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


# 6
def test_exact(spark):
    texts = ["a b", "ab", " a  b", None, "", "\t\n", "c", "c", "c"]
    docs = docs_of(spark, texts, [1, 2, 3, 4, 5, 6, 7, 7, None])
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows if r.doc_id in (1, 2, 3)) == [(1, 3, 3), (2, 3, 3), (3, 3, 3)]
    assert sorted(r.keep_id for r in rows if r.doc_id in (4, 5, 6)) == [6, 6, 6]
    assert sum(r.kept for r in rows) == 3
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["\t\n", " a  b", "c"]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_index_persists(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.exact_dedup(docs_of(spark, ["a", "b"]), index).collect()
    assert all(r.kept for r in first)
    spark.sql(f"DROP TABLE {index.name}")  # what a new session knows
    index = exact_dedup.DigestIndex(spark, index.path)
    again = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, ["b", "c", "c "], [10, 11, 12]), index).collect()}
    assert (again[10].kept, again[10].keep_id) == (False, 1) and again[12].kept and not again[11].kept
    assert index.best().count() == 3
    index = index.compact(index.path + "-compact")
    assert index.batches() == [3] and index.best().count() == index.table().count() == 3
    later = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, ["a  ", "d"], [20, 21]), index).collect()}
    assert (later[20].kept, later[20].keep_id, later[21].kept) == (False, 0, True)


def test_exact_run_again(spark):
    """A batch that is run again with its number gives the same answer, whatever it wrote before and what came after it."""
    index = exact_dedup.DigestIndex(spark)
    rng = random.Random(8)
    docs = docs_of(spark, [rng.choice("abcdefgh") + " " * rng.randint(0, 3) for _ in range(60)])
    other = docs_of(spark, ["a ", "x", "y"], [100, 101, 102])
    exact_dedup.exact_dedup(other, index, batch=0).collect()
    runs = []
    for _ in range(2):
        runs.append({r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, index, batch=2).collect()})
        exact_dedup.exact_dedup(docs_of(spark, ["q", "b"], [200, 201]), index, batch=4).collect()
    assert runs[0] == runs[1] and sum(kept for _, _, kept in runs[0].values()) == 7
    assert index.best().count() == 11


def test_exact_in_parts(spark, documents):
    """Parts that meet in the index give the winners of the whole."""
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), len(r.text or "")) for r in documents.collect()]
    best = {}
    for k, key, n in rows:
        best[key] = min(best.get(key, (1, 0)), (-n, k))
    want = {k: best[key][1] for k, key, _ in rows}
    for parts in (1, 2, 5):
        got = exact_dedup.exact_dedup(documents, parts=parts).collect()
        assert {r.doc_id: r.keep_id for r in got} == want and all(r.kept == (r.keep_id == r.doc_id) for r in got)


def test_exact_plan(spark, documents):
    """The anti-join merges the index as it lies: bucketed and sorted, without exchange or sort on its side."""
    index = exact_dedup.DigestIndex(spark)
    groups = exact_dedup.winners(exact_dedup.digests(documents))
    index.append(groups, 0)
    spark.conf.set(exact_dedup.ORDERED, "true")
    plan = index.unseen(groups, 1)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(exact_dedup.ORDERED)
    join, _, index_side = plan.partition("SortMergeJoin")
    scan = next(line for line in plan.splitlines() if "Bucketed: true" in line)
    depth = scan.index("FileScan")
    above = [line for line in plan.splitlines()[plan.splitlines().index(scan) - 3 : plan.splitlines().index(scan)] if "Exchange" in line or "Sort [" in line]
    assert index_side and depth and not above and plan.count("Exchange") == 2, plan
    assert index.unseen(groups, 1).count() == 0


def test_keep_first_keeps_the_longest(spark):
    docs = spark.createDataFrame([(1, "a b", "p"), (1, "a  b", "q"), (None, "c", "r"), (None, "c", "r"), (2, "c ", "s"), (3, None, "t"), (4, "x " * 50_000, "u")], "doc_id long, text string, __digest string")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["__digest"] for r in kept.collect()) == ["q", "s", "t", "u"]
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


# 7
def test_tokens():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    slow.encode_special_tokens = True
    fast = packing.tokens_of(packing.tokenizer_path())
    rng = random.Random(3)
    for text in ["", "<|endoftext|> a  b   c \n\n d\t", "½ ² 日本 🙂\r\n don't"] + ["".join(rng.choices("aZé1½ \n\t'.日", k=60)) for _ in range(300)]:
        ids = memoryview(fast(text)).cast("I").tolist()
        assert ids == slow.encode(text, add_special_tokens=False).ids


def test_special_tokens(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(3)
    texts = ["<|endoftext|> a", "a <|endoftext|>", "x<|endoftext|><|endoftext|>\n\n<|endoftext|", "<|ENDOFTEXT|> <|endoftext|>s  "] + ["".join(rng.choices(["<|endoftext|>", "<|", "a", " ", "\n", "'s", "é", "1"], k=20)) for _ in range(200)]
    want = [slow.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
    assert want[0] == [50256, 257, 1]
    got: dict[int, list] = {}
    for r in packing.pack_documents(docs_of(spark, texts), with_ids=True).collect():
        assert r.doc_tokens == len(want[r.doc_id])
        got.setdefault(r.doc_id, []).append((r.start, memoryview(bytes(r.ids)).cast("I").tolist()))
    assert [[x for _, part in sorted(got[k]) for x in part] for k in range(len(texts))] == want


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 3, 2047, 1, 900, 900, 900], [random.Random(4).randint(1, 4000) for _ in range(500)]])
def test_pack(lengths):
    pieces = packing.pack(lengths)
    seen, filled = Counter(), {}
    for k, start, n, seq, offset in pieces:
        seen[k] += n
        filled.setdefault(seq, []).append((offset, n))
    assert [seen[k] for k in range(len(lengths))] == lengths
    assert len(filled) == -(-sum(lengths) // 2048)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_packing_round_trip(spark, texts, documents):
    rows = packing.pack_documents(docs_of(spark, EDGE).select("doc_id", "text", "key").unionByName(documents.select(F.col("doc_id") + 1000, "text").withColumn("key", F.lit(0)).toDF("doc_id", "text", "key")), with_ids=True).collect()
    every = {k: t for k, t in enumerate(EDGE)} | {k + 1000: t for k, t in texts.items()}
    fast = packing.tokens_of(packing.tokenizer_path())
    got = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for k, t in every.items():
        assert b"".join(x for _, x in sorted(got[k])) == fast(t or "") + (1).to_bytes(4, "little")
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048


# 8
def brute_lines(texts):
    seen, gone = set(), {}
    for k in sorted(texts):
        lines = (texts[k] or "").split("\n")
        gone[k] = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone[k] |= {p, p + 1, p + 2}
            seen.add(w)
    return {k: sorted(v) for k, v in gone.items()}


def test_lines(spark):
    rng = random.Random(5)
    texts = {k: "\n".join(rng.choices("abc", k=rng.randint(0, 9))) for k in range(60)} | {60: None, 61: "", 62: "a\na\na\na\na"}
    rows = line_dedup.line_dedup(docs_of(spark, list(texts.values()))).collect()
    assert {r.doc_id: r.removed for r in rows} == brute_lines(texts)
    assert next(r for r in rows if r.doc_id == 60).text is None
    twice = line_dedup.line_dedup(docs_of(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc"], [None, 3, None])).collect()
    assert {(r.doc_id, len(r.removed)) for r in twice} == {(3, 0), (None, 3)}
    assert line_dedup.line_dedup(docs_of(spark, ["x"]).limit(0)).count() == 0


# 9
def test_quality(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/labels.parquet")
    machine = quality.fit(docs, labels)
    met = quality.score_documents(docs, machine).join(labels, "doc_id").where("held_out")
    assert met.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    rows = quality.score_documents(docs_of(spark, EDGE), machine).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    some = docs_of(spark, EDGE)
    assert quality.keep_good(some, machine).columns == some.columns
    assert quality.train([]).score("x") == pytest.approx(0.5, abs=0.05)


def test_machine_identity():
    m = quality.train([([1, 5, 9, *range(quality.BUCKETS, quality.BUCKETS + 15)], [0.5, 0.2, 0.1, *[0.3] * 15], 1), ([2, 5, *range(quality.BUCKETS, quality.BUCKETS + 15)], [0.4, 0.7, *[0.1] * 15], 0)])
    at, x = quality.features("some words and some more")
    x = m.inputs(at, x)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.margin(at, x)[0] == pytest.approx(m.bias + m.w[at] @ x + pairs)


# 10
def test_decontamination(spark, documents, texts):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bench = {r.item_id: r.text for r in items.collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents, items).collect()}
    want = {(d, i) for i, t in bench.items() for d, text in texts.items() if shingles(t) <= shingles(text)}
    assert want <= got
    assert all(len(shingles(bench[i]) & shingles(texts[d])) >= 0.7 * len(shingles(bench[i])) for d, i in got)
    clean = decontamination.decontaminate(documents, items)
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in got} and clean.columns == documents.columns
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, EDGE), odd).collect()} == {(6, 3), (7, 3)}
    assert decontamination.contaminated(docs_of(spark, EDGE), odd.limit(0)).count() == 0


def test_decontamination_short_items(spark):
    rest = " ".join(f"w{k}" for k in range(300))
    docs = docs_of(spark, [f"{rest} alpha, beta gamma {rest}", f"{rest} beta alpha gamma delta", "alpha beta gamma", f"{rest} epsilon", "why? alpha beta", f"{rest} so why alpha beta gamma delta", "alpha", None])
    items = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "epsilon"), (3, "alpha beta gamma delta"), (4, "Why? alpha"), (5, "alpha beta gamma delta zeta")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(0, 1), (2, 1), (5, 1), (3, 2), (5, 3), (4, 4), (5, 4)}


def test_wand_is_exact():
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randint(3, 30)))) for k in range(90)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontamination.build_index(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items))
    for _ in range(200):
        query = sorted({index.terms[w] for w in rng.choices([f"w{j}" for j in range(60)], k=rng.randint(1, 60)) if w in index.terms})
        scores = Counter()
        for t in query:
            for item, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[int(item)] += float(x)
        got = dict(decontamination.wand(index, decontamination.np.array(query)))
        assert got == pytest.approx({k: s for k, s in scores.items() if s >= 1 - 1e-6})


def test_pipeline(spark):
    """Every stage against brute force on what the one before kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    def run(name, docs):
        after = common.materialise(stages[name](spark, docs, DATA), "stage")
        assert after.columns == docs.columns and after.schema == docs.schema
        return after

    good = run("quality classifier", docs)
    machine = quality.fit(docs, labels)
    assert {r.doc_id for r in good.collect()} == {k for k, r in rows.items() if machine.score(r.text) >= quality.CUT}

    once = run("exact dedup", good)
    groups = {}
    for r in good.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in once.collect()} == {min(g)[1] for g in groups.values()}

    apart = run("near dedup", once)
    before, after = {r.doc_id: r.text for r in once.collect()}, {r.doc_id for r in apart.collect()}
    group = {k: k for k in before}
    for a, b in sorted(brute_links(before)):
        low, high = sorted((group[a], group[b]))
        group = {k: low if g == high else g for k, g in group.items()}
    assert after == set(group.values())

    clean = run("decontamination", apart)
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in apart.collect()}
    gone = set(left) - {r.doc_id for r in clean.collect()}
    overlap = {k: max(len(shingles(i) & shingles(t)) / len(shingles(i)) for i in items) for k, t in left.items()}
    assert {k for k, x in overlap.items() if x == 1} <= gone and all(overlap[k] >= 0.7 for k in gone)

    pieces = stages["packing"](spark, clean, DATA).collect()
    fast = packing.tokens_of(packing.tokenizer_path(), special=True)
    assert {r.doc_id: sum(p.length for p in pieces if p.doc_id == r.doc_id) for r in clean.collect()} == {r.doc_id: len(fast(r.text or "")) // 4 + 1 for r in clean.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == {r.doc_id for r in clean.collect()}


def test_pipeline_edges(spark):
    """Nulls, empties, repeated rows, a long text and clashing names in every stage; and no rows at all."""
    import corpus_pipeline

    docs = docs_of(spark, [*EDGE, "same text here", "same text here"], [*range(len(EDGE)), None, None]).withColumns({"__id": F.lit("a"), "__sum": F.lit("b"), "__digest": F.lit("c"), "__alone": F.lit("d")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        kept[name] = Counter(r.doc_id for r in out.collect())
        if name != "packing":
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert kept["exact dedup"] == Counter({2: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, None: 1})
    assert kept["near dedup"] == Counter({0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, 10: 1, None: 1})
    assert kept["decontamination"] == Counter([*range(len(EDGE)), None, None])
    assert set(kept["packing"]) == set(kept["decontamination"])

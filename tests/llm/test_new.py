"""The tokenizer alignment, the embedding links and the phrases against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import alignment, collocations, embedding_dedup, line_dedup, toxicity

SF = "/root/testdata/sf0.001"


# 11
@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_paths())


def slow_alignment(texts, pair):
    """Ids by the libraries on whole texts; groups, links and counts written out."""
    import public_tokenizers
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    made, counts = [], Counter()
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        same = text and all(b"".join(table[k] for k in ids) == b" " + text.encode() for table, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
        groups, links, own = [], [], ([], [])
        if same:
            ends = [(sum(len(pair.bytes_a[x]) for x in a[: i + 1]), 0, k) for i, k in enumerate(a)] + [(sum(len(pair.bytes_b[x]) for x in b[: i + 1]), 1, k) for i, k in enumerate(b)]
            at = Counter(e for e, _, _ in ends)
            for end, side, k in sorted(ends, key=lambda x: x[:2]):
                own[side].append(k)
                if side and at[end] == 2:
                    groups.append("|".join(",".join(map(str, x)) for x in own))
                    links.append((own[0][-1], k))
                    own = ([], [])
        made.append((len(a) if same else 0, len(b) if same else 0, groups, links))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, x in made]


ODD = [None, "", " ", "  a", "a  b ", "a▁b", "日本語 テキスト\n\n\t x", "<|endoftext|> <s> </s>", "naïve café 😀", "x" * 3000, "don't 1,234.5"]


def test_alignment(spark, pair):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if len(r.text) < 2500][:60] + ODD
    rows = [(k, t, "extra") for k, t in enumerate([*texts, *texts[:3]])]
    got = alignment.score_links(spark.createDataFrame(rows, "doc_id long, text string, n_links string").repartition(3)).orderBy("doc_id")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(r[c] for c in names) for r in got.collect()] == slow_alignment([t for _, t, _ in rows], pair)
    assert alignment.score_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = alignment.score_links(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert twice[0] == twice[1] and twice[0].doc_id is None


def test_words_are_encoded_as_in_whole_texts(pair):
    rng = random.Random(3)
    bits = ["a", "word", " ", "  ", "\n", "é", "日本", "\t", "123", ",", "'s", "<s>", " the", "x́", "́", " ", "😀"]
    assert pair.by_word
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        whole = pair.b.encode(text)
        same = b"".join(pair.bytes_b[k] for k in whole) == b" " + text.encode()
        found = pair.encode_second(text)
        assert (found is not None) == same and (not same or np.frombuffer(found, np.uint32).tolist() == whole)


def test_a_full_memo_changes_nothing(pair, monkeypatch):
    texts = ["one two three", "four five", "one two", "six seven eight nine"]
    want = [pair(t)[:4] for t in texts]
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 1)
    assert [pair(t)[:4] for t in texts + texts] == want + want


# 12
def linked(vectors, similarity=0.9):
    """(links, smallest id reachable) of each id by comparing all pairs."""
    scaled = lambda v: np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v)))
    fine = {i: scaled(v) for i, (_, v) in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {i: [] for i in range(len(vectors))}
    for i, a in fine.items():
        for j, b in fine.items():
            if j < i and len(a) == len(b) and a @ b >= similarity:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (k, _) in enumerate(vectors):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [vectors[j][0] for j in seen if vectors[j][0] is not None]
        out.append((k, len(near[i]), min(ids) if ids else None))
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    close = np.concatenate([base, base[:60] + 0.28 * rng.standard_normal((60, 16)), np.repeat(base[:1], 40, 0) + 0.1 * rng.standard_normal((40, 16)), base[:5] * 3, base[5:8]])
    rows = [(k, v.tolist()) for k, v in enumerate(close)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None, *[1.0] * 15]), (904, [float("nan")] * 16), (905, [float("inf"), *[0.0] * 15]), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e300] * 16), (909, [2e300] * 16), (910, [1e-300] * 16), (911, [-0.0, 1.0]), (912, [0.0, 1.0]), (913, base[0].tolist()), (913, base[1].tolist()), (None, base[2].tolist()), (None, [5.0, -1.0])]
    rows += odd
    got = embedding_dedup.link_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n long").repartition(4))
    order = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=order) == sorted(linked(rows), key=order)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_in_blocks(spark, monkeypatch):
    """A group of near copies that is larger than a block, and many small cells."""
    monkeypatch.setattr(embedding_dedup, "CELL", 32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    embedding_dedup.calibrate.cache_clear()
    rng = np.random.default_rng(5)
    close = np.concatenate([rng.standard_normal((400, 16)), rng.standard_normal((1, 16)) + 0.12 * rng.standard_normal((150, 16))])
    rows = [(k, v.tolist()) for k, v in enumerate(close)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    embedding_dedup.calibrate.cache_clear()
    want = {k: (n, c) for k, n, c in linked(rows)}
    ends = sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and sum(n for n, _ in got.values()) >= 0.999 * ends
    assert {k: c for k, (_, c) in got.items()} == {k: c for k, (_, c) in want.items()}


def test_calibration():
    for n in (1, 500, 50_000, 10**9):
        plan = embedding_dedup.calibrate(n)
        chance = embedding_dedup.collide(0.9, plan.bits)
        assert embedding_dedup.at_least(2, plan.projections, chance) >= 0.999 > embedding_dedup.at_least(2, plan.projections - 1, chance) or plan.projections == 2
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 32))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1, keepdims=True)
    plan = embedding_dedup.Plan(3, 20, embedding_dedup.calibrate(10).window)
    (ca, va), (cb, vb) = embedding_dedup.project(a, plan), embedding_dedup.project(b, plan)
    met = ((ca == cb) & (np.abs(va - vb) <= plan.window)).mean()
    assert met == pytest.approx(embedding_dedup.collide(0.9, 3), abs=0.01)


# 13
def slow_phrases(rows, least, top):
    low = {k: k + 32 for k in range(65, 91)}
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            for d in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        inside = {k[i:j] for k, v in found.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) and v >= found.get(k[i:j], v + 1)}
        scored = []
        for k in found.keys() - inside:
            score, cut = min((1000 * found[k] * n // (c[k[:x]] * c[k[x:]]), x) for x in range(1, len(k)))
            scored.append((-score, -found[k], " ".join(k).encode(), c[k[:cut]], c[k[cut:]], n))
        out += [(lang, i + 1, w.decode(), -a, x, y, n, -s) for i, (s, a, w, x, y, n) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard, top", [(50, 2000), (1 << 21, 7)])
def test_phrases(spark, shard, top):
    rng = random.Random(shard)
    word = lambda: rng.choice(["a", "B", "c", "ab", "x'y", "é", "Z z", "\x1f"])
    text = lambda: "".join(word() + rng.choice([" ", "  ", "\t", ".", ", ", "\n", "\r", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None]), text()) for _ in range(120)] + [("en", None), (None, ""), ("fr", "..."), ("en", "a b c ab " * 400), ("de", "É é É é")] * 2
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n long").repartition(5)
    assert sorted(map(tuple, collocations.collocations(docs, least=4, top=top, shard_words=shard).collect())) == slow_phrases(rows, 4, top)


def test_phrases_of_nothing(spark):
    schema = "lang string, text string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two three")], schema)).count() == 0
    # Counts whose products pass 64 bits.
    spelt = spark.createDataFrame([("en", ["a", "b"], 10**12, False)], "lang string, words array<string>, a long, inside boolean")
    frequent = spark.createDataFrame([("en", "a", 2 * 10**12), ("en", "b", 10**12)], "lang string, word string, f long")
    row = collocations.score_phrases(spelt, frequent, spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")).first()
    assert row.score == 1000 * 10**12 * 9 * 10**13 // (2 * 10**12 * 10**12)


def test_index_extends_both_ways():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, 500)
    index = collocations.Index(x, 5)
    text = [0, *x.tolist(), 0]
    s, n, low, back = index.words()
    ids = index.symbols[s][:, None]
    for size in range(1, 6):
        for k, row in enumerate(ids.tolist()):
            places = [i for i in range(len(text) - size + 1) if text[i : i + size] == row]
            assert n[k] == len(places)
            for left, side in ((True, {text[i - 1] for i in places}), (False, {text[i + size] for i in places})):
                if size < 5:
                    assert index.alone(n[k : k + 1], (low if left else back)[k : k + 1], left)[0] == (side.pop() if len(side) == 1 else 0)
        if size < 5:
            parent, symbol, n, low, back = index.extend_right(n, low, back)
            ids = np.concatenate([ids[parent], index.symbols[symbol][:, None]], axis=1)
            assert len({*map(tuple, ids.tolist())}) == len(ids) == len({tuple(text[i : i + size + 1]) for i in range(len(text) - size) if 0 not in text[i : i + size + 1]})


# 8
def test_long_text_of_lines(spark):
    """Twice the lines take about twice the time; each of two copies is removed whole."""
    import time

    took = []
    for n in (20_000, 20_000, 80_000):
        text = "\n".join(f"line {k}" for k in range(n))
        start = time.time()
        rows = {r.doc_id: (r.text, len(r.removed)) for r in line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id int, text string")).collect()}
        took.append(time.time() - start)
        assert rows == {1: (text, 0), 2: ("last", n)}
    assert took[2] < 8 * took[1] + 5


# 2
def test_chain_is_trained_out_of_fold():
    """The probabilities that a later link is trained on are those of models that did not see the text."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(120):
        a = int(rng.random() < 0.4)
        at = sorted({10 + a, *rng.integers(100, 110, 3).tolist()})
        rows.append((at, [a, int(a and rng.random() < 0.8)]))
    seen = {}
    real = toxicity._logistic

    def watched(matrix, y, always):
        seen.setdefault(matrix.dense.shape[1], []).append((matrix, y))
        return real(matrix, y, always)

    toxicity._logistic = watched
    try:
        chain = toxicity.train(rows, ["first", "second"])
    finally:
        toxicity._logistic = real
    # The first link: three fits on two thirds each, then one on all. The second gets one column of probabilities.
    assert [m.n for m, _ in seen[0]] == [80, 80, 80, 120] and [m.n for m, _ in seen[1]] == [80, 80, 80, 120]
    fold = np.random.default_rng(toxicity.SEED).permutation(120) % toxicity.FOLDS
    found, texts = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    buckets = found[texts >= toxicity.LEAST_TEXTS]
    want = np.full(120, 0.5)
    for f in range(toxicity.FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        cells = lambda some: [np.searchsorted(buckets, [b for b in rows[i][0] if b in set(buckets.tolist())]) for i in some]
        w, b = real(toxicity._Rows(cells(rest), len(buckets), np.zeros((len(rest), 0))), np.array([rows[i][1][0] for i in rest], float), np.empty(0, np.int64))
        want[own] = 1 / (1 + np.exp(-(toxicity._Rows(cells(own), len(buckets), np.zeros((len(own), 0))).times(w) + b)))
    assert np.allclose(seen[1][-1][0].dense[:, 0], want)
    p = np.array([chain.predict(np.array(at)) for at, _ in rows])
    assert p.shape == (120, 2) and p[[r[1][0] == 1 for r in rows], 0].mean() > 0.9

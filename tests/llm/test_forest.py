"""The MinHash forest: depths, tries and meeting places against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join as join
from corpusloom.llm.common import fresh, shingle_hashes, words


def brute_links(texts, t=0.8):
    sets = {k: set(shingle_hashes(words(v)).tolist()) for k, v in texts.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def test_least_similarity():
    for n in range(1, 60):
        every = [c / (n + m - c) for m in range(1, 80) for c in range(1, min(n, m) + 1) if not c == n == m and c / (n + m - c) >= 0.8 - 1e-12]
        assert join.least_similarity(n) == (pytest.approx(min(every)) if every else None), n


def test_depth_varies_by_text():
    found = {n: join.matched_depth(n) for n in range(1, 200)}
    assert {None, 7, 8, 10} == set(found.values()) and found[3] is None and found[7] == 10 and found[150] == join.matched_depth(10_000) == 7
    for n, depth in found.items():
        if depth:
            least = join.least_similarity(n)
            assert 1 - (1 - least**depth) ** join.TREES >= join.RECALL
            assert depth == join.LABELS or 1 - (1 - least ** (depth + 1)) ** join.TREES < join.RECALL
    # Whatever two texts can be linked, both stand at the depth of the one that searches further down.
    for n in range(1, 120):
        for m in range(n, int(n / 0.8) + 1):
            common = -(-8 * (n + m) // 18)
            if common <= n and not common == n == m:
                assert join.depth_mask(n) & join.depth_mask(m) & (1 << min(found[n], found[m])), (n, m)
    with pytest.raises(ValueError):
        join.matched_depth(1000, similarity=0.1, trees=2)


def test_walk_finds_every_shared_prefix(spark):
    rng = random.Random(1)
    keys = [(bytes([rng.randrange(2)]) + bytes(rng.randrange(3) for _ in range(4)), k, rng.choice([1 << 2, 1 << 3, 1 << 2 | 1 << 4])) for k in range(400)]
    entries = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in keys], "key binary, rep long, depths int")
    got = Counter((r.node, r.rep) for r in join.walk_tries(entries, 4).collect())
    hashed = {r.p: r.h for r in spark.createDataFrame([(bytearray(key[: d + 1]),) for key, _, _ in keys for d in (2, 3, 4)], "p binary").distinct().select(F.hex("p").alias("p"), F.xxhash64("p").alias("h")).collect()}
    want = set()
    for key, rep, mask in keys:
        for d in (2, 3, 4):
            if mask >> d & 1 and any(other[: d + 1] == key[: d + 1] for other, k, _ in keys if k != rep):
                want.add((hashed[key[: d + 1].hex().upper()], rep))
    assert want <= set(got) and max(got.values()) == 1 and len(got) <= len(want) + 3 * 2 * spark.sparkContext.defaultParallelism


def test_common_prefix():
    keys = np.array([[0, 1, 2], [0, 1, 3], [0, 1, 3], [1, 1, 3], [1, 2, 3]], np.uint8)
    assert join.common_prefix(keys).tolist() == [-1, 1, 2, -1, 0]


@pytest.fixture(scope="module")
def tangled():
    """A chain of texts that each share most with the next few, and a cluster of near copies."""
    rng = random.Random(2)
    stream = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    base = [f"v{k}" for k in range(80)]
    texts = {k: " ".join(stream[4 * k : 4 * k + 60]) for k in range(200)}
    for k in range(200, 280):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(80)] = f"x{rng.randrange(50)}"
        texts[k] = " ".join(own)
    return texts


@pytest.mark.parametrize("block", [512, 4])
def test_chain_and_cluster(spark, tangled, block, monkeypatch):
    """Both ways of meeting give the links of brute force; a long chain in small blocks meets prefix by prefix, a cluster as a whole."""
    ways = []
    inner = join.meeting_places

    def watched(*args):
        out = inner(*args)
        ways.append({(r.prefixes, r.one): r["count"] for r in out.select(F.col("nodes").isNotNull().alias("prefixes"), (F.col("blocks") == 1).alias("one")).groupBy("prefixes", "one").count().collect()})
        return out

    monkeypatch.setattr(join, "meeting_places", watched)
    docs = spark.createDataFrame([*tangled.items(), (900, tangled[5]), (901, None)], "doc_id long, text string")
    pairs = brute_links({**tangled, 900: tangled[5]})
    want = Counter(x for pair in pairs for x in pair)
    rows = {r.doc_id: r for r in join.jaccard_join(docs, block=block).collect()}
    assert {k: r.n_links for k, r in rows.items()} == {k: want[k] for k in rows}
    assert len({rows[k].class_id for k in range(200)}) == 1
    assert any(k[0] for k in ways[0]) == (block == 4)
    if block == 4:
        moved = sum(v for k, v in ways[0].items() if k[0])
        assert moved <= join.TREES * 200  # in proportion to the chain, not to its square


def test_keep_one_leaves_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (1, "a b c d e f", "x", "y", "z"), (None, None, "x", "y", "z")], "doc_id long, text string, __id string, __sum string, __ALONE string")
    kept = join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.distinct().collect()))
    assert fresh(docs, "id") == "__id_" and fresh(docs, "alone") == "__alone_" and fresh(docs, "own") == "__own"

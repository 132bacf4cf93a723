"""Cases of the third round's last findings."""

import random
from collections import Counter

import numpy as np

from corpusloom.llm import alignment, collocations
from corpusloom.functions.html import bodies_text
from corpusloom.operators import export
from corpusloom.plans import selection


def test_exported_reading_age_at_a_half(spark):
    """56 words of two syllables in one sentence: the grade 29.85, whose double lies below, is 29.9 as in SQL."""
    page = spark.createDataFrame([("/a", "x", "label " * 56 + ".", "2026-09-15")], "url string, content_id string, search_text string, last_seen_at string")
    links = spark.createDataFrame([("/a", "en", "primary")], "url string, organisation_slug string, role string")
    got = export.export(selection.rated(page), links, ["readability", "primary_org"], selection.ASOF).first()
    assert tuple(got) == ("/a", 34.9, "en")


def test_windows_are_encoded_as_in_whole_texts():
    """Both tokenizers' ids window by window, many in one call, against the libraries' on whole texts; each window is read once."""
    pair = alignment.Pair(*alignment.default_paths())
    rng = random.Random(5)
    bits = ["a", "word", " ", " ", "  ", "\n", "é", "日本", "\t", "123", ",", "'s", "<s>", "<|endoftext|>", "x́", "́", "😀", "\xa0", "\x1c", "▁", " "]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        parts = pair.windows(text)
        assert " ".join(parts) == text
        a, b = np.frombuffer(pair.a(" " + text), "<u4").tolist(), pair.b.encode(text)
        same = b"".join(pair.bytes_b[k] for k in b) == b" " + text.encode()
        found = [pair.encode([w]) for w in parts]
        assert (None not in [x if x is None else 0 for x in found]) == same
        if same:
            assert [[k for x in found for k in x[side].tolist()] for side in (0, 1)] == [a, b]
        assert pair(text)[:2] == ((len(a), len(b)) if same else (0, 0))
    pair.forget()
    read = []
    first = pair.a
    pair.a = lambda text: read.append(text) or first(text)
    assert pair("one two one")[:2] == (3, 3) and pair("two three one")[0] == 3
    assert read == [" one two", " three"]


def test_memo_is_bounded_by_bytes(monkeypatch):
    """Texts without blanks are one window each, so their number alone bounds nothing."""
    pair = alignment.Pair(*alignment.default_paths())
    monkeypatch.setattr(alignment, "MEMO_BYTES", 10_000)
    for k in range(20):
        pair(f"日本語{k}" * 200)
        assert pair.held < 40_000
    assert len(pair.memo) < 20


def test_pairs_and_threes_grow_with_the_text():
    """Pairs with the word that follows, as counted by hand; never more rows than places, whatever becomes frequent."""
    rng = np.random.default_rng(3)
    made = []
    for n in (2_000, 10_000):
        x = rng.integers(0, 40, n)
        text = [*x.tolist(), 0, 0]
        want = Counter((a << 32 | b, c) for a, b, c in zip(text, text[1:], text[2:]) if a and b)
        pair, after, count = collocations.pairs_and_next(collocations.Index(x, 3))
        assert dict(zip(zip(pair.tolist(), after.tolist()), count.tolist(), strict=True)) == want
        assert len(pair) == len(want) <= n and count.sum() == sum(want.values())
        made.append(len(pair))
    assert made[1] <= 5 * made[0]


def test_phrases_inside_others(spark):
    """A phrase is inside where one with a word more has its count, in front or behind."""
    key = lambda *ids: bytearray(np.array(ids, ">u4").tobytes())
    counts = {(1, 2): 7, (2, 3): 5, (3, 4): 9, (1, 2, 3): 5, (2, 3, 4): 4, (9, 8): 3}
    found = spark.createDataFrame([(key(*k), a) for k, a in counts.items()], "key binary, a long")
    got = {bytes(r.key): (r.a, r.inside) for r in collocations.mark_inside(found).collect()}
    assert got == {bytes(key(*k)): (a, k == (2, 3)) for k, a in counts.items()}


def test_texts_of_several_bodies(spark):
    """Each body is read with its bare names, whatever its place; null and empty ones leave nothing."""
    rows = spark.createDataFrame([(["<p>a &amp b</p>", None, "", "<p>c</p>"],), (None,)], "x array<string>")
    assert [r[0] for r in rows.select(bodies_text(rows.x)).collect()] == ["a & b c", ""]

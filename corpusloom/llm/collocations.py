"""Phrase collocations: an FM-index for each shard over word ids, counts summed over the shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

#: Words of a phrase at most, its least count, and phrases returned for each language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Words of a shard. It is closed at the end of the piece that reaches them.
SHARD_WORDS = 1 << 21
#: What parts pieces becomes a full stop, which no word can hold; A-Z become a-z.
_PARTING = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if b in _PARTING else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Parts that a language's phrases are ranked in before the last ranking, so that no task ranks them all.
_SALT = 64


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, and ``b"."`` after each piece."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split(b" ") + [b"."]


class Index:
    """Bidirectional FM-index of one shard, ordered by the first ``depth`` words only.

    ``before`` holds the word before each suffix of the text in their order (the BWT), ``after``
    the same of the reversed text, which is the word that follows; ``step`` takes a place of the
    reversed order to that of the longer suffix (the LF mapping). A phrase of up to ``depth`` words is an
    interval of both orders; an order by fewer words than a suffix has leaves these intervals exact.
    """

    def __init__(self, x: np.ndarray, depth: int = DEPTH):
        x = np.concatenate([[0], x, [0]]).astype(np.int64)
        self.depth = depth
        self.symbols, x = np.unique(x, return_inverse=True)  # dense, and 0 stays the least
        self.text = x.astype(np.int32)
        backward = np.ascontiguousarray(x[::-1])
        self.after = backward[self._order(backward, depth) - 1].astype(np.int32)
        self.step = np.empty(len(x), np.int64)
        self.step[np.argsort(self.after, kind="stable")] = np.arange(len(x))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(self.symbols)))])

    @cached_property
    def before(self) -> np.ndarray:
        """The word before each suffix, sorted when first asked for: counting needs the reversed order only."""
        x = self.text.astype(np.int64)
        return self.text[self._order(x, self.depth) - 1]

    @staticmethod
    def _order(x: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes by their first ``depth`` words: ranks of 1, 2, 4 ... words are joined to those of the rest."""
        rank, done, ranks = x, 1, {1: x}
        while True:
            part = max(k for k in ranks if k <= depth - done) if done < depth else 0
            if not part:
                return np.argsort(rank, kind="stable")
            later = np.zeros(len(x), np.int64)
            later[: max(0, len(x) - done)] = ranks[part][done:] + 1
            key = rank * (int(ranks[part].max()) + 2) + later
            done += part
            if done == depth:
                return np.argsort(key, kind="stable")
            rank = np.unique(key, return_inverse=True)[1]
            ranks[done] = rank

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of all single words: (symbol, count, place in the order, place in the reversed order)."""
        s = np.arange(1, len(self.symbols)) if len(self.symbols) and self.symbols[0] == 0 else np.arange(len(self.symbols))
        low = self.starts[s]
        return s, self.starts[s + 1] - low, low, low

    def extend_right(self, n: np.ndarray, low: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All phrases that are one word longer to the right: (phrase extended, symbol, count, both places)."""
        parent = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(back, n) + offset
        symbol = self.after[rows]
        order = np.argsort(parent * len(self.symbols) + symbol, kind="stable")
        parent, symbol, rows = parent[order], symbol[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])])) if len(parent) else np.empty(0, np.int64)
        count = np.diff(np.concatenate([first, [len(parent)]]))
        # Sorted by the following word, a phrase's suffixes stand as its extensions do here.
        forward = low[parent[first]] + first - (np.cumsum(n) - n)[parent[first]]
        real = self.symbols[symbol[first]] > 0
        return parent[first][real], symbol[first][real], count[real], forward[real], self.step[rows[first]][real]

    def alone(self, n: np.ndarray, at: np.ndarray, left: bool) -> np.ndarray:
        """The one word that stands before (after) every occurrence of a phrase; 0 where they differ or a piece begins (ends)."""
        if not len(n):
            return np.empty(0, np.int64)
        beside = (self.before if left else self.after)[np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        cut = np.cumsum(n) - n
        low, high = np.minimum.reduceat(beside, cut), np.maximum.reduceat(beside, cut)
        return np.where(low == high, self.symbols[low], 0)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word ids."""
    out = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        out = (out ^ ids[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether rows of word ids are among those of the sorted hashes ``known``; a foreign row passes once in 2^64 at each, and is counted in vain."""
    if not len(known):
        return np.zeros(len(ids), bool)
    own = mixed(ids)
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def pairs_and_next(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs with each word that follows them: (pair as ``first << 32 | second``, the word or 0 where the piece ends, count).

    They count the pairs and the phrases of three words at once. There is at most one row for each
    place of a word, whatever share of the pairs becomes frequent.
    """
    symbol, n, low, back = index.words()
    parent, second, n, low, back = index.extend_right(n, low, back)
    pair = (index.symbols[symbol[parent]] << 32) | index.symbols[second]
    parent, third, c, *_ = index.extend_right(n, low, back)
    rest = n - np.bincount(parent, c, minlength=len(n)).astype(np.int64)
    last = np.flatnonzero(rest)
    return np.concatenate([pair[parent], pair[last]]), np.concatenate([index.symbols[third], np.zeros(len(last), np.int64)]), np.concatenate([c, rest[last]])


def phrases(index: Index, known: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``length`` words: (ids of the words, a row a phrase; counts).

    ``known`` has the frequent phrases that are one word shorter, a row each. Only phrases whose
    first and last words are among them are followed: others can't be frequent, as a phrase is no
    more frequent than one in it.
    """
    symbol, n, low, back = index.words()
    ids = index.symbols[symbol][:, None]
    whole = np.sort(mixed(known))
    for size in range(2, length + 1):
        parent, symbol, n, low, back = index.extend_right(n, low, back)
        ids = np.concatenate([ids[parent], index.symbols[symbol][:, None]], axis=1)
        good = among(ids[:, 1:], whole) if size == length else among(ids, np.unique(mixed(known[:, :size])))
        ids, n, low, back = ids[good], n[good], low[good], back[good]
    return ids, n


def build_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``shard, lang, words, counts, ids``: each task's texts of one language, as ids into the shard's own words (0 ends a piece)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        open_shards: dict[str, tuple[dict, list]] = {}
        made = 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            known, parts = open_shards.pop(lang)
            ids = np.concatenate([np.array(p, np.int32) for p in parts])
            counts = np.bincount(ids, minlength=len(known))[1:]
            words = [w.decode("utf-8", "replace") for w in list(known)[1:]]
            made += 1
            blob = zstandard.ZstdCompressor(1).compress(ids.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["shard", "lang", "words", "counts", "ids"])

        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = tokens(text.as_py())
                for at in range(0, len(found), shard_words):
                    # A long text goes over several shards, each of which ends with a piece.
                    begin, end = at and _piece_end(found, at), _piece_end(found, at + shard_words)
                    if begin >= end:
                        continue
                    if lang not in open_shards:
                        open_shards[lang], sizes[lang] = ({b".": 0}, []), 0
                    known, parts = open_shards[lang]
                    ids = [known.setdefault(w, len(known)) for w in found[begin:end] if w]
                    parts.append(np.array(ids, np.int32))
                    sizes[lang] += len(ids)
                    if sizes[lang] >= shard_words:
                        yield close(lang)
        for lang in list(open_shards):
            yield close(lang)

    return rows.mapInArrow(run, "shard bigint, lang string, words array<string>, counts array<bigint>, ids binary")


def _piece_end(found: list[bytes], at: int) -> int:
    """The place after the first piece's end from ``at`` on."""
    return len(found) if at >= len(found) else found.index(b".", at) + 1


def _ids(shard: pa.Table, local: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A shard's ids as those of the frequent words; others part phrases as a piece's end does."""
    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(shard.column("ids")[0].as_py()), np.int32)
    table = np.zeros(shard.column("size")[0].as_py() + 1, np.int64)
    table[local] = known
    return table[own]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are counted, then the phrases of two and three words in one round over the shards' ids,
    then those of four and five in a round each: a shard enumerates the phrases by interval
    extension, from the frequent words and next shorter phrases that it holds itself, and the counts
    are summed over the shards. None of these lists is sent whole. Counts are exact: what is left
    out in a shard holds a word or a phrase that is too rare over all shards. A phrase is dropped if
    one that has a word more has its count; where a still longer one has it, so has one of these.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words
    of the language; the score is exact for counts below 10^15. Ties go by ``a``, then by phrase in
    UTF-8 order. A null text holds no word and a null language is ``und``. Ids are not read, so
    repeated rows count again. No rows, and no phrase with ``least`` occurrences, give no rows.
    """
    shards = materialise(build_shards(docs, lang_col, text_col, shard_words), "shards")
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("shard", "lang", (F.col("at") + 1).alias("at"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    counted = local.groupBy("lang", "word").agg(F.sum("c").alias("f"))
    totals = materialise(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n")), "totals")
    frequent = number_words(counted.where(F.col("f") >= least))
    mapped = local.join(frequent.select("lang", "word", "word_id"), ["lang", "word"])
    mapped = materialise(mapped.select("shard", "at", "word_id"), "mapped")

    ids = shards.select("shard", "ids", F.size("words").alias("size")).groupBy("shard")
    seen = ids.cogroup(mapped.groupBy("shard")).applyInArrow(short_phrases, "pair bigint, next bigint, shard bigint, c bigint")
    # One sort does for all three. A row a shard for each word after a pair, so a window holds no more than the shards' words.
    pair = Window.partitionBy("pair")
    seen = seen.withColumn("first", F.row_number().over(pair.orderBy("next")) == 1).withColumn("f2", F.sum("c").over(pair)).withColumn("f3", F.sum("c").over(Window.partitionBy("pair", "next")))
    two, three = F.col("first") & (F.col("f2") >= least), (F.col("next") > 0) & (F.col("f3") >= least)
    often = materialise(seen.where(two | three), "phrases-3")
    hexed = F.lpad(F.hex("pair"), 16, "0")
    new = often.where(three).select("shard", F.unhex(F.concat(hexed, F.lpad(F.hex("next"), 8, "0"))).alias("key"), F.col("f3").alias("f"))
    found = [often.where(two).select(F.unhex(hexed).alias("key"), F.col("f2").alias("a")), new.groupBy("key").agg(F.max("f").alias("a"))]
    for length in range(4, DEPTH + 1):
        if new.isEmpty():
            break
        facts = mapped.select("shard", "at", "word_id", F.lit(None).cast("binary").alias("key")).unionAll(new.select("shard", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("word_id"), "key"))
        seen = ids.cogroup(facts.groupBy("shard")).applyInArrow(_finder(length), "key binary, shard bigint, c bigint")
        # One row a shard for each phrase, so a window holds as many rows as there are shards at most.
        new = materialise(seen.withColumn("f", F.sum("c").over(Window.partitionBy("key"))).where(F.col("f") >= least), f"phrases-{length}")
        found.append(new.groupBy("key").agg(F.max("f").alias("a")))
    candidates = mark_inside(materialise(reduce(DataFrame.unionAll, found), "phrases"))
    return rank_phrases(score_phrases(spell(candidates, frequent), frequent, totals), top)


def mark_inside(found: DataFrame) -> DataFrame:
    """``key, a, inside`` of all frequent phrases: whether one with a word more in front or behind has the same count."""
    size = F.length("key")
    parts = F.array(F.substring("key", F.lit(1), size - 4), F.substring("key", F.lit(5), size - 4))
    longer = found.where(size > 8).select(F.explode(parts).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    return found.join(longer, "key", "left").select("key", "a", (F.coalesce("most", F.lit(0)) >= F.col("a")).alias("inside"))


def short_phrases(_, shard: pa.Table, own: pa.Table) -> pa.Table:
    """The map over a shard and its frequent words: its pairs with each word that follows."""
    made = [np.empty(0, np.int64)] * 3
    if shard.num_rows and own.num_rows:
        made = pairs_and_next(Index(_parted(_ids(shard, own.column("at").to_numpy(), own.column("word_id").to_numpy())), 3))
    number = np.full(len(made[0]), shard.column("shard")[0].as_py() if shard.num_rows else 0, np.int64)
    return pa.table([pa.array(made[0]), pa.array(made[1]), pa.array(number), pa.array(made[2])], ["pair", "next", "shard", "c"])


def _parted(x: np.ndarray) -> np.ndarray:
    """Word ids with one 0 where there were several in a row."""
    return x[(x > 0) | (np.concatenate([[1], x[:-1]]) > 0)]


def _finder(length: int):
    """The map over a shard and what is known of it: the phrases of ``length`` words in it."""

    def phrases_of(_, shard: pa.Table, own: pa.Table) -> pa.Table:
        rows, n = np.empty((0, length), np.int64), np.empty(0, np.int64)
        keys = own.column("key").drop_null().to_pylist()
        if shard.num_rows and keys:
            known = np.frombuffer(b"".join(keys), ">u4").astype(np.int64).reshape(-1, length - 1)
            place, word = own.column("at").to_numpy(), own.column("word_id").to_numpy()
            # Words in none of the known phrases part phrases, as rare words and pieces do.
            keep = (place > 0) & np.isin(word, np.unique(known))
            rows, n = phrases(Index(_parted(_ids(shard, place[keep], word[keep])), length), known, length)
        offsets = pa.py_buffer((np.arange(len(rows) + 1) * 4 * length).astype(np.int32).tobytes())
        made = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.astype(">u4").tobytes())])
        number = np.full(len(rows), shard.column("shard")[0].as_py() if shard.num_rows else 0, np.int64)
        return pa.table([made, pa.array(number), pa.array(n)], ["key", "shard", "c"])

    phrases_of.__name__ = f"phrases_of_{'four five'.split()[length - 4]}"
    return phrases_of


def number_words(counted: DataFrame) -> DataFrame:
    """``lang, word, f, word_id``: ids from 1 on without large gaps, so that they fit into 32 bits."""
    kept = materialise(counted.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at")), "words")
    sizes = {r["part"]: r["m"] for r in kept.groupBy("part").agg((F.max("at") + 1).alias("m")).collect()}  # a row a partition
    starts, total = [], 1
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    if total >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    begin = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts or [1]]), F.col("part") + 1)
    return kept.select("lang", "word", "f", (begin + F.col("at")).alias("word_id"))


def spell(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lang, words, a, inside`` of phrases given as big-endian 32-bit ids."""
    size = (F.length("key") / 4).cast("int")
    word = lambda i: F.conv(F.hex(F.substring("key", i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    split = candidates.select("key", "a", "inside", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), word)).alias("at", "word_id"))
    named = split.join(frequent.select("word_id", "lang", "word"), "word_id")
    whole = named.groupBy("key").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("inside").alias("inside"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"))
    return materialise(whole.select("lang", F.col("x.word").alias("words"), "a", "inside"), "spelt")


def score_phrases(spelt: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that lie inside no longer one of the same count; the lowest cut counts."""
    text = F.array_join("words", " ")
    counts = spelt.select("lang", text.alias("part"), "a").unionAll(frequent.select("lang", "word", "f"))
    size = F.size("words")
    cuts = spelt.where(~F.col("inside")).select("lang", text.alias("phrase"), "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def rank_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first phrases of each language, ranked in parts before all remaining ones are."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Benchmark decontamination: every training passage queries a BM25 index of the test items."""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import materialise, ordered_shingles, shingle_hashes, words

K1, B = 1.2, 0.75
#: Words of a passage; the next one begins half a passage later.
PASSAGE = 128
#: Share of an item's highest possible score from which a passage is looked at closely.
THRESHOLD = 0.6
#: Share of the shingles of question and of answer that must be met.
OVERLAP, SHINGLE = 0.8, 5
#: Items under one block maximum.
POSTING_BLOCK = 4
#: Items of one index (about so many, and characters), and bytes of the indexes that one pass over the documents sends to every task.
INDEX_ITEMS, INDEX_CHARS, PASS_BYTES = 4096, 8 << 20, 64 << 20
#: Half passages whose terms' bounds are gathered at once.
_HALVES = 256


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question and answer.

    The answer follows the last question mark, else the last line break, else it is the last
    sentence. An item of one sentence is a question without an answer.
    """
    text = text.strip()
    for cut in (text.rfind("?") + 1, text.rfind("\n") + 1):
        if 0 < cut < len(text):
            return text[:cut], text[cut:]
    stops = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    return (text[: stops[-1]], text[stops[-1] :]) if stops else (text, "")


@dataclass
class Index:
    """Postings of some items: for each term, item numbers and impacts, and their maxima by block.

    Impacts are BM25 weights divided by the score that a passage must reach for the item, so 1 is
    the threshold of every item.
    """

    item_ids: list
    terms: dict[str, int]
    items: list[np.ndarray]
    impacts: list[np.ndarray]
    bounds: tuple[np.ndarray, np.ndarray, np.ndarray]  # block maxima of the postings: where a term's begin, their blocks, their values
    parts: list[tuple[np.ndarray, np.ndarray]]  # shingles of question and answer
    sizes: list[int]  # words of their shingles: ``SHINGLE``, or all words of a shorter item

    @property
    def blocks(self) -> int:
        return max(1, -(-len(self.item_ids) // POSTING_BLOCK))

    def reach(self, group: np.ndarray, term: np.ndarray, groups: int) -> np.ndarray:
        """Sums of the block maxima of terms, by group and block. A term has maxima only for the blocks of its postings."""
        start, block, value = self.bounds
        own = start[term + 1] - start[term]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[term], own)
        key = np.repeat(group, own) * self.blocks + block[at]
        return np.bincount(key, value[at], groups * self.blocks).reshape(groups, self.blocks)


def covering(words_in_item: int) -> int:
    """Passages side by side that hold an item of so many words, wherever it begins: one of them has this share of its weight at least."""
    return max(1, -(-(words_in_item + PASSAGE // 2 - 1) // PASSAGE))


def build_index(rows: list[tuple], frequency: dict[str, int], count: int, mean_length: float, threshold: float = THRESHOLD) -> Index:
    """Index ``rows`` of (id, text) with the document frequencies, number and mean length of all items."""
    terms: dict[str, int] = {}
    postings: list[tuple[list[int], list[float]]] = []
    parts, sizes = [], []
    for number, (_, text) in enumerate(rows):
        tokens = words(text)
        counts: dict[str, int] = {}
        for w in tokens:
            counts[w] = counts.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(tokens) / max(mean_length, 1e-9))
        weight = {w: math.log(1 + (count - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in counts.items()}
        need = threshold * sum(weight.values()) / covering(len(tokens))
        for w, x in weight.items():
            at = terms.setdefault(w, len(postings))
            if at == len(postings):
                postings.append(([], []))
            postings[at][0].append(number)
            postings[at][1].append(x / need)
        question, answer = (len(words(x)) for x in question_and_answer(text))
        # A part shorter than a shingle is met with the words beside it.
        first, last = tokens[: max(question, SHINGLE)], tokens[-max(answer, SHINGLE) :] if answer else []
        sizes.append(min(SHINGLE, len(tokens)))
        parts.append((shingle_hashes(first, SHINGLE), shingle_hashes(last, SHINGLE)))
    start, block, value = [0], [np.empty(0, np.int64)], [np.empty(0)]
    for who, impact in postings:
        own, at = np.unique(np.array(who) // POSTING_BLOCK, return_index=True)
        block.append(own)
        value.append(np.maximum.reduceat(np.array(impact), at))
        start.append(start[-1] + len(own))
    bounds = (np.array(start), np.concatenate(block), np.concatenate(value))
    return Index([r[0] for r in rows], terms, [np.array(p[0], np.int64) for p in postings], [np.array(p[1]) for p in postings], bounds, parts, sizes)


def wand(index: Index, query: np.ndarray) -> list[tuple[int, float]]:
    """All items whose impacts over the distinct terms of ``query`` reach 1, by block-max WAND.

    The lists are walked side by side in the order of their current items. The pivot is the first
    item at which the upper bounds of the lists before it could reach 1. Items lie in blocks, and
    a block whose maxima over the query don't sum to 1 is leapt over by all lists at once.
    """
    open_blocks = np.flatnonzero(index.reach(np.zeros(len(query), np.int64), query, 1)[0] >= 1 - 1e-6)
    if not len(open_blocks):
        return []
    lists = [index.items[t] for t in query]
    impacts = [index.impacts[t] for t in query]
    highest = [float(x.max()) for x in impacts]
    end, found = len(index.item_ids), []
    at, current = [0] * len(lists), [0] * len(lists)

    def move(k: int, to: int) -> None:
        at[k] += int(np.searchsorted(lists[k][at[k] :], to))
        current[k] = int(lists[k][at[k]]) if at[k] < len(lists[k]) else end

    def next_open(item: int) -> int:
        """``item`` if its block is open, else the first item of the next open one."""
        n = int(np.searchsorted(open_blocks, item // POSTING_BLOCK))
        return end if n == len(open_blocks) else max(item, int(open_blocks[n]) * POSTING_BLOCK)

    for k in range(len(lists)):
        move(k, next_open(0))
    order = list(range(len(lists)))
    while True:
        order = sorted((k for k in order if current[k] < end), key=current.__getitem__)
        total, pivot = 0.0, -1
        for n, k in enumerate(order):
            total += highest[k]
            if total >= 1 - 1e-6:
                pivot = n
                break
        if pivot < 0:
            return found
        item = current[order[pivot]]
        leap = next_open(item)
        if leap > item:
            for k in order:
                if current[k] < leap:
                    move(k, leap)
            continue
        while pivot + 1 < len(order) and current[order[pivot + 1]] == item:
            pivot += 1
        scored = current[order[0]] == item
        if scored:
            score = sum(float(impacts[k][at[k]]) for k in order[: pivot + 1])
            if score >= 1 - 1e-6:
                found.append((item, score))
        for k in order[: pivot + 1]:
            if current[k] < item:
                move(k, item)
            elif scored:
                at[k] += 1
                current[k] = int(lists[k][at[k]]) if at[k] < len(lists[k]) else end


def matches(index: Index, tokens: list[str], overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
    """(item number, best score, question overlap, answer overlap) of each item that a text of these words holds."""
    if not tokens:
        return []
    other, step = len(index.terms), PASSAGE // 2
    ids = np.fromiter(map(index.terms.get, tokens, itertools.repeat(other)), np.int64, len(tokens))
    best: dict[int, float] = {}
    # The bounds of half passages, each term once: two neighbours bound the passage they make up.
    half = np.arange(len(ids)) // step
    kept = np.unique(half * (other + 1) + ids)
    kept = kept[kept % (other + 1) != other]
    if not len(kept):
        return []
    group, term = kept // (other + 1), kept % (other + 1)
    before, highest = np.zeros(index.blocks), np.zeros(half[-1] + 1)
    for low in range(0, int(half[-1]) + 1, _HALVES):
        some = slice(*np.searchsorted(group, [low, low + _HALVES]))
        sums = index.reach(group[some] - low, term[some], min(_HALVES, int(half[-1]) + 1 - low))
        both = np.vstack([before, sums])
        highest[low : low + len(sums)] = (both[:-1] + both[1:]).max(axis=1)
        before = sums[-1]
    # ``highest`` of a half is that of the passage which it ends; the last half is a passage by itself, too.
    for k in sorted({max(0, int(h) - 1) for h in np.flatnonzero(highest >= 1 - 1e-6)}):
        query = np.unique(ids[k * step : k * step + PASSAGE])
        for item, score in wand(index, query[query < other]):
            best[item] = max(best.get(item, 0.0), score)
    if not best:
        return []
    own = {size: np.unique(ordered_shingles(tokens, size)) for size in {index.sizes[item] for item in best}}
    found = []
    for item, score in sorted(best.items()):
        question, answer = index.parts[item]
        met = [_met(part, own[index.sizes[item]]) for part in (question, answer)]
        if min(met) >= overlap:
            found.append((item, score, *met))
    return found


def _met(part: np.ndarray, own: np.ndarray) -> float:
    """Share of the shingles of ``part`` that the document has. An empty part is met."""
    return float(np.isin(part, own, assume_unique=True).mean()) if len(part) else 1.0


def index_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``block, bytes, index``: the test items in pickled indexes of bounded size, built on the executors.

    Frequencies and lengths are those of all items. Items without words are left out: nothing can
    hold them. No items give no rows.
    """
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    item = rows.schema["item"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in batch.column("text").to_pylist()]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], ["item", "text", "words"])
            yield out.filter(pa.array([bool(w) for w in found], pa.bool_()))

    worded = materialise(rows.mapInArrow(split, f"item {item}, text string, words array<string>").withColumn("row", F.monotonically_increasing_id()), "items")
    count, chars, mean = worded.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.avg(F.size("words"))).first()
    blocks = max(1, -(-count // INDEX_ITEMS), -(-(chars or 0) // INDEX_CHARS))
    terms = worded.select("row", F.explode(F.array_distinct("words")).alias("term"))
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = terms.join(frequency, "term").groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    dealt = worded.select("row", "item", "text").join(known, "row").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def build(table: pa.Table) -> pa.Table:
        frequency = {t["term"]: t["n"] for found in table.column("terms").to_pylist() for t in found}
        own = sorted(zip(*(table.column(c).to_pylist() for c in ("item", "text")), strict=True), key=lambda r: (r[0] is None, r[0], r[1]))
        made = pickle.dumps(build_index(own, frequency, count, mean, threshold), pickle.HIGHEST_PROTOCOL)
        return pa.table({"block": [table.column("block")[0].as_py()], "bytes": [len(made)], "index": [made]}, schema=pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("index", pa.binary())]))

    return materialise(dealt.groupBy("block").applyInArrow(build, "block bigint, bytes bigint, index binary"), "indexes")


def passes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> Iterator[Broadcast]:
    """The indexes as broadcast lists of at most ``PASS_BYTES`` (or one index), each for one pass over the documents."""
    blocks = index_blocks(items, id_col, text_col, threshold)
    group, size = [], 0
    # One row an index: a few numbers for every some thousand items.
    for row in [*blocks.select("block", "bytes").orderBy("block").collect(), None]:
        if group and (row is None or size + row.bytes > PASS_BYTES):
            held = blocks.where(F.col("block").isin(group)).orderBy("block").select("index").collect()
            yield items.sparkSession.sparkContext.broadcast(Indexes([bytes(r["index"]) for r in held]))
            group, size = [], 0
        if row is not None:
            group.append(row.block)
            size += row.bytes


class Indexes:
    """Pickled indexes, opened once in every Python worker."""

    def __init__(self, raw: list[bytes]):
        self.raw, self._open = raw, None

    def __getstate__(self):
        return {"raw": self.raw, "_open": None}

    def __call__(self) -> list[Index]:
        if self._open is None:
            self._open, self.raw = [pickle.loads(r) for r in self.raw], []
        return self._open


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of each test item that a document holds.

    Every passage of ``PASSAGE`` words of every text queries the index; items whose score reaches
    ``THRESHOLD`` of what a passage holds at least of the whole item are retrieved, all of them, and
    stay if the document has at least ``OVERLAP`` of the five-word shingles of the item's question
    and of its answer. An item of fewer than five words is held where all its words stand in its
    order side by side. ``score`` is a multiple of the item's threshold.

    A null or empty text holds nothing. Items that are null or without words are left out; a part
    of an item without words counts as met. Repeated items and rows are answered alike, null ids
    stay null. Without items or documents there are no rows. Further columns are not read. Words
    are lower-case runs of letters, digits and underscores. The indexes of about 20,000 items go
    along in one pass over the documents; further ones take a further pass.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key, item = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item}, score double, question_overlap double, answer_overlap double"
    kind = to_arrow_type(items.schema[item_id].dataType)
    done: list[DataFrame] = []
    for sent, last in with_last(passes(items, item_id, item_text)):

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    tokens = words(text)
                    for index in sent.value():
                        for number, *rest in matches(index, tokens):
                            ids.append(k)
                            found.append((index.item_ids[number], *rest))
                names, *numbers = zip(*found, strict=True) if found else ((), (), (), ())
                arrays = [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(names, kind), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(find, schema)
        done.append(part if last else _written(part, sent, "hits"))
    return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], schema)


def with_last(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether it is the last."""
    before = None
    for item in items:
        if before is not None:
            yield before, False
        before = item
    if before is not None:
        yield before, True


def _written(part: DataFrame, sent: Broadcast, name: str) -> DataFrame:
    """A pass's rows, written; then no task needs its indexes any more, so only one pass's are held at a time."""
    out = materialise(part, name)
    sent.unpersist(blocking=False)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns and without a shuffle.

    A null or empty text stays, and so does every row if there are no items. Repeated rows are
    judged alike. No rows give no rows; no column is changed, whatever its name.
    """
    for sent, last in with_last(passes(items, item_id, item_text)):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                split = map(words, batch.column(text_col).to_pylist())
                yield batch.filter(pa.array([not any(matches(index, tokens) for index in sent.value()) for tokens in split], pa.bool_()))

        kept = docs.mapInArrow(clean, docs.schema)
        docs = kept if last else _written(kept, sent, "clean")
    return docs


def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
